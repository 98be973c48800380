"""Distinct counts that are stored once and answer any roll-up.

``distinct_sketches`` keeps a HyperLogLog sketch of a fixed size per group and column.
``roll_up`` merges stored sketches by any subset of the groups, without the rows: exact
distinct counts of groups can't be added up, as a hospital may be in several of them.

The relative standard error is about 0.83 / sqrt(2^lg_k) (0.6 % for the default) for large
counts; up to some thousand values a sketch holds them nearly exactly. Merging loses nothing:
what is merged in several steps, or in any order, equals what is merged at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14


def distinct_sketches(df: DataFrame, groups: list[str], columns: list[str], lg_k: int = LG_K) -> DataFrame:
    """(groups..., column_name, n_rows, sketch): values of each column in each group; nulls aren't values.

    One pass: a task holds a sketch for each group and column that it meets.
    """
    long = df.select(*groups, *[F.col(c).cast("string").alias(f"_{c}") for c in columns]).unpivot(
        ids=groups, values=[f"_{c}" for c in columns], variableColumnName="column_name", valueColumnName="_value")
    return long.groupBy(*groups, F.substring("column_name", 2, 1 << 20).alias("column_name")).agg(
        F.count("_value").alias("n_rows"), F.hll_sketch_agg("_value", F.lit(lg_k)).alias("sketch"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketches.groupBy(*groups, "column_name").agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame) -> DataFrame:
    """``sketches`` with n_distinct in place of the sketch."""
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], F.hll_sketch_estimate("sketch").alias("n_distinct"))


def roll_up(sketches: DataFrame, levels: list[list[str]], groups: list[str]) -> DataFrame:
    """Estimates of several levels in one table: (groups..., column_name, n_rows, n_distinct, level); groups
    that a level leaves out are null. ``level`` names the groups that it keeps."""
    out = None
    for kept in levels:
        part = estimates(merge(sketches, kept))
        missing = [F.lit(None).cast(sketches.schema[g].dataType).alias(g) for g in groups if g not in kept]
        part = part.select("*", *missing).select(*groups, "column_name", "n_rows", "n_distinct", F.lit(",".join(kept)).alias("level"))
        out = part if out is None else out.unionByName(part)
    return out
