"""Shards of nearly equal size by longest-processing-time scheduling.

Rows with equal texts form a group and stay together. Groups are summed up by
Spark; those that hold a ``heads``-th of all bytes or more, of which there can be no
more than ``heads``, are scheduled one by one, all others in ``heads`` bundles by a
hash of their text (a group is never split). Items go, from the largest to the
smallest, to the least-loaded shard, taken from a heap. The heap sees at most
2 x ``heads`` items whatever the corpus holds, each bundle is about a ``heads``-th of
the rest, and so shards come out within a small part of a percent.

Slots number the rows of a shard from 0 without gaps. Rows are numbered within
cells (a shard's part by a hash of the row) of about ``cell_rows`` rows, and the
cells' counts are added up, so neither a shard nor a hot group meets in one task.

Defined results: a null text has no bytes; it groups with other null texts and
with empty ones, whose texts are the same empty sequence of bytes. Ties in size
go by the text's hash, then to the shard with the smaller number. Repeated rows are
rows of their own with slots of their own. An empty table gives no rows. A very long text is
one size; its bytes are read where it is. The id and text columns alone are read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage, text_key, whole


def longest_first(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Shard of each (size, name) item: largest first, to the least-loaded shard."""
    loads = [(0, shard) for shard in range(shards)]
    chosen = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + size, shard))
        chosen[name] = shard
    return chosen


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16,
           heads: int = 8192, cell_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    spark = docs.sparkSession
    text = whole(F.col(text_col))
    rows = stage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), text_key(F.col(text_col)).alias("key")), "shard-rows")
    groups = stage(rows.groupBy("key").agg(F.sum("size").alias("total"), F.count("*").alias("n")), "shard-groups")
    size, count = groups.agg(F.sum("total"), F.sum("n")).first()
    is_head = F.col("total") * F.lit(heads) >= F.lit(int(size or 0))
    bundle = F.pmod(F.xxhash64("key.a", "key.b"), F.lit(heads))
    top = [(r["total"], (0, r["key"]["a"], r["key"]["b"])) for r in groups.where(is_head).collect()]  # at most ``heads`` rows
    rest = groups.where(~is_head).groupBy(bundle.alias("bundle")).agg(F.sum("total").alias("total"))
    bundles = [(r["total"], (1, r["bundle"], 0)) for r in rest.collect()]  # at most ``heads`` rows
    plan = longest_first(top + bundles, shards)
    single = spark.createDataFrame([(a, b, s) for (k, a, b), s in plan.items() if k == 0], "a long, b long, own int")
    single = single.select(F.struct("a", "b").alias("key"), "own")
    shared = spark.createDataFrame([(a, s) for (k, a, _), s in plan.items() if k == 1], "bundle long, other int")
    placed = rows.withColumn("bundle", bundle)
    placed = placed.join(F.broadcast(single), "key", "left").join(F.broadcast(shared), "bundle", "left")
    cells = max(16, -(-int(count or 0) // (shards * cell_rows)))
    placed = placed.select("doc_id", "size", "text_crc32", "key", F.coalesce("own", "other").alias("shard"),
                           F.pmod(F.xxhash64(F.lit("cell"), "doc_id", "key.a"), F.lit(cells)).alias("cell"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("shard", "cell").orderBy("doc_id", "key")
    numbered = placed.withColumn("place", F.row_number().over(within) - 1).join(offsets, ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("offset")).cast("long").alias("slot"))
