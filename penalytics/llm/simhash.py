"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a fingerprint bit is 1
if it is set in over half of the XXH64 hashes (seed 42) of the text's
``shingle``-word sequences, repeats included.

Two fingerprints at most ``distance`` bits apart share a variant that lies at
most ceil(distance / 2) bits from either. So every distinct fingerprint emits all
variants of that radius; a shuffle brings equal variants together, and the
fingerprints that meet there are paired. A variant's ball has a fixed number of
points, so no group grows with the corpus. Neighbours in the sorted group are
linked (a chain), which for even distances joins just what all pairs would; for
odd ones every pair of the (bounded) ball is looked at. Links are deduplicated,
verified by their differing bits, and closed to components.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; fewer words than a shingle: the
whole sequence is the only one. Ties and repeated rows share a component. A null
id never names a component unless the component has no other. Very long texts are hashed
whole, in blocks of bits; an empty table gives no rows; filters keep all columns, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare_workers, shielded, stage, text_key, whole
from .components import components

SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) > shingle:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    else:
        parts, n = [b" ".join(words)], 1
    ones = np.zeros(64, np.int64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), ">u8", n)
    for at in range(0, n, 1 << 16):
        block = codes[at: at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint_of(text: Column, shingle: int = 3) -> Column:
    """Fingerprint of a text column as a signed long."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return run(whole(text).cast("binary"))


def _masks(radius: int) -> list[int]:
    """All 64-bit values with at most ``radius`` bits set, as signed longs."""
    values = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def links(fingerprints: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a > b) that join all distinct fingerprints (column fp) at most ``distance`` bits apart."""
    masks = F.array(*[F.lit(m).cast("long") for m in _masks((distance + 1) // 2)])
    balls = fingerprints.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    if distance % 2 == 0:  # all members of a ball lie within the distance of each other
        near = W.partitionBy("v").orderBy("fp")
        pairs = balls.select("fp", F.lag("fp").over(near).alias("b")).where("b is not null").select(F.col("fp").alias("a"), "b")
    else:
        other = balls.select(F.col("fp").alias("b"), "v")
        pairs = balls.select(F.col("fp").alias("a"), "v").join(other, "v").where("a > b").select("a", "b")
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, key (the text's 128-bit key), fp, component_id, keeper of each row's component.

    ``keeper`` is the struct (no_id, doc_id, key) that comes first: the row that a filter keeps.
    """
    prepare_workers(docs.sparkSession)
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"),
                             fingerprint_of(F.col(text_col), shingle).alias("fp")), "simhash")
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = stage(rows.groupBy("fp").agg(F.min(me).alias("keeper")), "simhash-distinct")
    roots = components(links(first.select("fp"), distance))
    linked = first.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    of_root = linked.groupBy("root").agg(F.min("keeper").alias("of_root"))
    of_fp = linked.join(of_root, "root").select("fp", "of_root")
    best = first.join(of_fp, "fp", "left").select("fp", F.coalesce("of_root", "keeper").alias("keeper"))
    # staged, so that the join deals both sides anew and a fingerprint of very many rows is split
    best = stage(best, "simhash-keepers")
    return rows.join(best, "fp").select("doc_id", "key", "fp", F.col("keeper.doc_id").alias("component_id"), "keeper")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without those that near-duplicate one with a smaller id."""
    plain, (i, t) = shielded(docs, id_col, text_col)
    found = near_duplicates(plain, i, t, **options)
    gone = found.where(~(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("key") == F.col("keeper.key"))))
    gone = gone.select(F.col("doc_id").alias("__x_id"), F.col("key").alias("__x_gone")).distinct()
    marked = plain.withColumn("__x_key", text_key(F.col(t)))
    left = marked.join(gone, marked[i].eqNullSafe(gone["__x_id"]) & (F.col("__x_key") == F.col("__x_gone")), "left_anti")
    # of repeated rows (equal id and text) one stays
    return left.dropDuplicates([i, "__x_key"]).select(*plain.columns).toDF(*docs.columns)
