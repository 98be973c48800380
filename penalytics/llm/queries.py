"""The registered queries of the subpackage, and DuckDB SQL where it can express them.

Every query applies its operator, with its production parameters, to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, decontaminate, exact_dedup, html_extract, language_id, license_scan, prefix_trie, quality_gam,
               sentencepiece_codec, sharding, simhash, token_alignment, warc)
from .common import table

#: A public SentencePiece model; any other file of that kind will do.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: A public byte-level tokenizer.
A_FILE = "/opt/tokenizers/byte_bpe_50k.json"


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), model_file)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, then reads them back."""
    folder, manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.members(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations``, and one more of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.digests(chat_format.format_turns(chat_format.canonical_turns(rows.unionByName(more))))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds a copy."""
    found = decontaminate.find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "end_word")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_documents(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str, a_file: str = A_FILE, b_file: str = MODEL_FILE) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), a_file, b_file)


def op12_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of ``conversations`` after each has taken over the first turns of its block's first one."""
    nodes = prefix_trie.trie(*prefix_trie.lend_heads(prefix_trie.keyed_turns(table(spark, sf_dir, "conversations"))))
    return nodes.drop("node", "parent")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_sentencepiece, op2_warc, op3_exact_dedup, op4_html_extract, op5_sharding, op6_simhash, op7_license_scan,
    op8_chat_format, op9_decontaminate, op10_language_id, op11_token_alignment, op12_quality_gam, op13_prefix_trie)}

ORACLES: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS low, row_number() OVER (PARTITION BY html ORDER BY page_id) AS k FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
         ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN low END AS refers_to
FROM r""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op7_license_scan": license_scan.oracle(),
    "op8_chat_format": chat_format.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
