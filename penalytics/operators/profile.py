"""Profiling in few passes.

Each profile is one ``agg`` with an expression per column (or per column
pair), reshaped afterwards with ``unpivot``: one scan, partial aggregation
map-side, a single small exchange.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import NA_TOKENS
from ..functions.scalar import round_half_even
from .clean import columns_of_kind
from .ordered import exact_quantiles


def dataset_stats(df: DataFrame, hospital: str = "facility_name", state: str = "state",
                  condition: str = "measure_name", approx: bool = False) -> DataFrame:
    """Rows, columns and distinct hospitals, states, conditions (NULL excluded).

    ``approx=True`` uses HyperLogLog++ (``approx_count_distinct``, ~2% error):
    one pass with a fixed-size sketch per task instead of the exact distinct
    aggregation's extra shuffle of distinct values.
    """
    distinct = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        distinct(hospital).alias("n_hospitals"),
        distinct(state).alias("n_states"),
        distinct(condition).alias("n_conditions"))


def _is_missing(df: DataFrame, c: str, na_tokens: bool) -> F.Column:
    col = F.col(c)
    dtype = df.schema[c].dataType
    miss = col.isNull()
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        miss = miss | F.isnan(col)
    if na_tokens and isinstance(dtype, T.StringType):
        miss = miss | F.trim(col).isin(NA_TOKENS)
    return miss


def missing_profile(df: DataFrame, na_tokens: bool = True) -> DataFrame:
    """A3 (+S7 dtypes): column, data_type, missing_count, missing_pct (unrounded).

    ``na_tokens`` counts the CSV reader's NA spellings in string columns as
    missing, as a default CSV load would have.
    """
    cols = df.columns
    sums = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.sum(F.when(_is_missing(df, c, na_tokens), 1).otherwise(0)).cast("bigint").alias(c)
        for c in cols])
    long = sums.unpivot(ids=["_n"], values=cols, variableColumnName="column_name",
                        valueColumnName="missing_count")
    types = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))])
    position = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return long.select(
        "column_name",
        position[F.col("column_name")].alias("position"),
        types[F.col("column_name")].alias("data_type"),
        "missing_count",
        (F.lit(100.0) * F.col("missing_count") / F.col("_n")).alias("missing_pct"),
        round_half_even(F.lit(100.0) * F.col("missing_count") / F.col("_n"), 2).alias("missing_pct_2dp"))


def missing_top(df: DataFrame, k: int = 10) -> DataFrame:
    """Missing counts sorted descending (ties by column name), top k."""
    return (missing_profile(df, na_tokens=False)
            .orderBy(F.col("missing_count").desc(), F.col("column_name").asc()).limit(k))


def any_missing(df: DataFrame) -> DataFrame:
    """A5: does any column have a missing value?"""
    return missing_profile(df, na_tokens=False).agg(
        (F.max("missing_count") > 0).alias("any_missing"),
        F.sum(F.when(F.col("missing_count") > 0, 1).otherwise(0)).cast("bigint").alias("n_columns_missing"))


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, "number")


def describe(df: DataFrame, columns: list[str] | None = None, approx_quantiles: bool = False) -> DataFrame:
    """A6, transposed: one row per numeric column with count, mean, sample std,
    min, exact 25/50/75 % and max.  Quantiles come from ``exact_quantiles``
    (not ``summary()``, whose percentiles are approximate).

    ``approx_quantiles=True`` swaps in ``percentile_approx`` (a bounded
    sketch per task, one pass, no ordering step): the choice for a quick look
    at very large tables.  Approximate quantiles are actual data values.
    """
    columns = columns or numeric_columns(df)
    if approx_quantiles:
        return df.agg(*[
            F.struct(F.count(c).alias("count"), F.avg(F.col(c).cast("double")).alias("mean"),
                     F.stddev_samp(F.col(c).cast("double")).alias("std"),
                     F.min(F.col(c).cast("double")).alias("min"),
                     F.percentile_approx(F.col(c).cast("double"), [0.25, 0.5, 0.75], 10000).alias("q"),
                     F.max(F.col(c).cast("double")).alias("max")).alias(c)
            for c in columns]).unpivot(ids=[], values=columns, variableColumnName="column_name",
                                       valueColumnName="m").select(
            "column_name", "m.count", "m.mean", "m.std", "m.min",
            F.col("m.q")[0].alias("p25"), F.col("m.q")[1].alias("p50"), F.col("m.q")[2].alias("p75"), "m.max")
    moments = df.agg(*[
        F.struct(F.count(c).alias("count"), F.avg(F.col(c).cast("double")).alias("mean"),
                 F.stddev_samp(F.col(c).cast("double")).alias("std"),
                 F.min(F.col(c).cast("double")).alias("min"),
                 F.max(F.col(c).cast("double")).alias("max")).alias(c)
        for c in columns])
    long = moments.unpivot(ids=[], values=columns, variableColumnName="column_name",
                           valueColumnName="m").select("column_name", "m.*")
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    wide_q = q.groupBy("column_name").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("p25"),
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("p50"),
        F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("p75"))
    # Both sides have one row per column: the join is between two tiny tables.
    return long.join(wide_q, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def correlation_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation for every ordered pair, pairwise-complete rows.

    One ``agg`` computes corr for each unordered pair; the diagonal is 1 when a
    column has any variance.  Output (col_a, col_b, corr), both orders.
    """
    columns = columns or numeric_columns(df)
    pairs = list(combinations(columns, 2))
    exprs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)]
    exprs += [F.when(F.stddev_samp(F.col(c).cast("double")) > 0, F.lit(1.0)).alias(f"d{i}")
              for i, c in enumerate(columns)]
    one = df.agg(*exprs)
    stack = []
    for i, (a, b) in enumerate(pairs):
        stack += [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{i}").alias("corr")),
                  F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"{i}").alias("corr"))]
    for i, c in enumerate(columns):
        stack.append(F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.col(f"d{i}").alias("corr")))
    return one.select(F.inline(F.array(*stack))).select(
        "col_a", "col_b", F.when(F.isnan("corr"), F.lit(None).cast("double")).otherwise(F.col("corr")).alias("corr"))


def preview(df: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """First n rows in a stated order (file order is not defined in Spark)."""
    order = order or df.columns[:1]
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


def box_fences(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles, IQR and the 1.5 x IQR fences, one row per column."""
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    return q.groupBy("column_name").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("median"),
        F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q3")) \
        .withColumn("iqr", F.col("q3") - F.col("q1")) \
        .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr")) \
        .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr"))


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column Q1, median, Q3, 1.5 x IQR fences, whiskers (the most
    extreme values inside the fences) and the outlier count.

    The fences table has one row per column (size fixed by the call), so it
    is broadcast to the value scan.
    """
    fences = box_fences(df, columns)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ids=[], values=columns, variableColumnName="column_name", valueColumnName="value") \
        .where(F.col("value").isNotNull())
    v = F.col("value")
    inside = (v >= F.col("lower_fence")) & (v <= F.col("upper_fence"))
    return long.join(F.broadcast(fences), "column_name").groupBy(
        "column_name", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence").agg(
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("bigint").alias("n_outliers"))


def box_outliers(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """The rows outside the 1.5 x IQR fences, long form (key..., column_name, value)."""
    stats = box_fences(df, columns).select("column_name", "lower_fence", "upper_fence")
    long = df.select(*key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ids=key, values=columns, variableColumnName="column_name", valueColumnName="value") \
        .where(F.col("value").isNotNull())
    v = F.col("value")
    return long.join(F.broadcast(stats), "column_name").where(
        (v < F.col("lower_fence")) | (v > F.col("upper_fence"))).select(*key, "column_name", "value")
