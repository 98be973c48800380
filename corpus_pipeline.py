"""From raw documents to token ids: five stages, each an operator of ``penalytics.llm``.

A stage gets what its predecessor kept, written as Parquet and read again; all but
the last return the columns of ``documents``.

* language ID: documents without a known language go;
* exact dedup: of equal texts the row with the largest id stays;
* SimHash near-dedup: of each component (2 bits, 3-word shingles) the row with the
  smallest id stays;
* benchmark decontamination: documents that hold a copy of an item go;
* SentencePiece: doc_id, token_ids, n_tokens, token_crc32, round_trip.

Nulls, empty tables, ties and repeated rows: as the operators define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from penalytics.llm import decontaminate, exact_dedup, language_id, sentencepiece_codec, simhash
from penalytics.llm.common import stage, table
from penalytics.llm.queries import MODEL_FILE


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, distance=2)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs, MODEL_FILE)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_copies),
    ("sentencepiece", tokenize),
]

#: The language model, the fingerprints and the search for merges are no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; every stage's rows are written to the shared folder first."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
