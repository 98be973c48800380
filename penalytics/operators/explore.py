"""Exploration aggregates.

Rates are built from integer counts (``100 * sum(label) / count``), so they do
not depend on the order in which partial sums are merged.  Every top-k is an
``orderBy(...).limit(k)`` with a full tie-break, which Spark plans as
``TakeOrderedAndProject``: each task keeps k rows, no global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import LABEL, MEASURE, STATE


def _rate(label: str = LABEL) -> F.Column:
    return (F.lit(100.0) * F.sum(F.col(label)) / F.count(F.lit(1)))


def label_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Count and share of each label value (share of all rows, in %)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # The total is a scalar subquery: one global partial/final aggregate, no join.
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.select(F.col(label), F.col("n"), (F.lit(100.0) * F.col("n") / total).alias("pct"))


def penalty_rate_overall(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Overall penalty rate in %, with the counts behind it."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(F.col(label)).cast("bigint").alias("n_penalized"),
                  _rate(label).alias("penalty_rate_pct"))


def penalty_rate_by(df: DataFrame, key: str, top: int | None = None, label: str = LABEL) -> DataFrame:
    """A10/A11 (+T1): penalty rate per ``key`` in %, optionally the top-k by rate."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"),
                              F.sum(F.col(label)).cast("bigint").alias("n_penalized"),
                              _rate(label).alias("penalty_rate_pct"))
    if top is not None:
        out = out.orderBy(F.col("penalty_rate_pct").desc(), F.col(key).asc()).limit(top)
    return out


def top_penalized_conditions(df: DataFrame, k: int = 10, key: str = MEASURE,
                             label: str = LABEL) -> DataFrame:
    """The k conditions with the most penalised rows (ties -> name)."""
    return (df.where(F.col(label) == 1).groupBy(key).agg(F.count(F.lit(1)).alias("n_penalized"))
            .orderBy(F.col("n_penalized").desc(), F.col(key).asc()).limit(k))


def condition_label_counts(df: DataFrame, k: int = 10, key: str = MEASURE,
                           label: str = LABEL) -> DataFrame:
    """A13 via J3: (condition, label) counts restricted to the top-k conditions.

    The top-k list has at most k rows by construction, so the semi join
    broadcasts a side of proven size.
    """
    top = F.broadcast(top_penalized_conditions(df, k, key, label).select(key))
    return (df.join(top, key, "left_semi").groupBy(key, label)
            .agg(F.count(F.lit(1)).alias("n_rows")))


def distinct_sorted(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-null values.  Callers sort when they collect."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def histogram_by_label(df: DataFrame, column: str | list[str], bins: int = 30,
                       label: str = LABEL) -> DataFrame:
    """Equal-width histograms split by label, for one or many columns.

    Bin i covers [lo + i*w, lo + (i+1)*w), the last bin is closed.  All
    columns go through one long (column_name, value, label) pass: the (lo, hi)
    bounds are one grouped aggregate with a row per column (a size fixed by
    the call, hence broadcast), then one grouped count per (column, bin, label).
    """
    columns = [column] if isinstance(column, str) else list(column)
    long = df.select(F.col(label), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ids=[label], values=columns, variableColumnName="column_name", valueColumnName="value") \
        .where(F.col("value").isNotNull())
    bounds = long.groupBy("column_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("value")
    nb = F.lit(float(bins))
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((v - lo) / ((hi - lo) / nb)), F.lit(bins - 1)))
    counts = (long.join(F.broadcast(bounds), "column_name")
              .groupBy("column_name", b.cast("int").alias("bin"), label, "lo", "hi")
              .agg(F.count(F.lit(1)).alias("n_rows")))
    return counts.select("column_name", "bin", label, "n_rows",
                         (lo + F.col("bin") * (hi - lo) / nb).alias("bin_start"),
                         (lo + (F.col("bin") + 1) * (hi - lo) / nb).alias("bin_end"))


def with_benchmark(df: DataFrame, bench: DataFrame, key: str = MEASURE) -> DataFrame:
    """Benchmark penalty rate by exact condition name (left join; no match
    gives NULL).  ``bench`` is a literal six-row table: broadcast is safe."""
    return df.join(F.broadcast(bench), key, "left")


def with_state_name(df: DataFrame, states: DataFrame, key: str = STATE) -> DataFrame:
    """Code -> full name (left join against the literal 56-row map)."""
    s = states.select(F.col("code").alias(key), F.col("name").alias("state_name"))
    return df.join(F.broadcast(s), key, "left")


def state_code_for_name(df: DataFrame, states: DataFrame, name_col: str = "state_name") -> DataFrame:
    """J2, reverse direction: full name -> code."""
    s = states.select(F.col("name").alias(name_col), F.col("code").alias("state_code"))
    return df.join(F.broadcast(s), name_col, "left")
