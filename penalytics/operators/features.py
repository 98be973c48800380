"""Feature preparation.

The estimators here are ``pyspark.ml`` stages so they sit inside a
``Pipeline`` and are fitted on the training rows only:

* ``ExactMedianImputer`` -- exact interpolated median (Spark's ``Imputer``
  returns a lower median from an approximate sketch).
* ``ModeImputer`` -- most frequent string, ties to the smallest value.
* ``PopulationScaler`` -- (x - mean) / population std; zero std divides by 1
  (Spark's ``StandardScaler`` uses the sample std).

Fitting computes a handful of numbers with distributed aggregates and keeps
them as params (so ``PipelineModel.save`` persists them); transforming is a
projection with literals.

The stratified split ranks rows inside each class by a seeded hash with
``rank_within`` (buckets of the hash's top bits, with offsets), so no unbounded
class is gathered into one task, and gives exact per-class test sizes.
"""

from __future__ import annotations

import json
from fractions import Fraction

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clean import LABEL
from .ordered import exact_median, most_frequent, rank_within


class _HasColumns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to process", TypeConverters.toListString)
    fitted = Param(Params._dummy(), "fitted", "fitted values as JSON", TypeConverters.toString)

    def _values(self) -> dict:
        return json.loads(self.getOrDefault(self.fitted))


class _FittedModel(Model, _HasColumns, DefaultParamsReadable, DefaultParamsWritable):
    pass


class ImputerModelExact(_FittedModel):
    @keyword_only
    def __init__(self, inputCols=None, fitted=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fills = self._values()
        return dataset.select(*[
            F.coalesce(F.col(c), F.lit(fills[c])).alias(c) if c in fills and fills[c] is not None else F.col(c)
            for c in dataset.columns])


class ExactMedianImputer(Estimator, _HasColumns, DefaultParamsReadable, DefaultParamsWritable):
    """M1: fill NULL numerics with the exact median of the fitting rows."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ImputerModelExact:
        cols = self.getOrDefault(self.inputCols)
        med = {r["column_name"]: r["median"] for r in exact_median(dataset, cols).collect()}
        return ImputerModelExact(inputCols=cols, fitted=json.dumps({c: med.get(c) for c in cols}))


class ModeImputer(Estimator, _HasColumns, DefaultParamsReadable, DefaultParamsWritable):
    """M2: fill NULL strings with the most frequent value (ties -> smallest)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ImputerModelExact:
        cols = self.getOrDefault(self.inputCols)
        mode = {r["column_name"]: r["mode"] for r in most_frequent(dataset, cols).collect()}
        return ImputerModelExact(inputCols=cols, fitted=json.dumps({c: mode.get(c) for c in cols}))


class PopulationScalerModel(_FittedModel):
    outputSuffix = Param(Params._dummy(), "outputSuffix", "suffix of scaled columns", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, fitted=None, outputSuffix="_scaled"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        stats = self._values()
        suffix = self.getOrDefault(self.outputSuffix)
        return dataset.select("*", *[
            ((F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1] if stats[c][1] else 1.0)).alias(c + suffix)
            for c in self.getOrDefault(self.inputCols)])


class PopulationScaler(Estimator, _HasColumns, DefaultParamsReadable, DefaultParamsWritable):
    """M3: standardise with the population std in one aggregate pass."""
    outputSuffix = Param(Params._dummy(), "outputSuffix", "suffix of scaled columns", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, outputSuffix="_scaled"):
        super().__init__()
        self._setDefault(outputSuffix="_scaled")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        cols = self.getOrDefault(self.inputCols)
        row = scaling_stats(dataset, cols).collect()
        stats = {r["column_name"]: [r["mean"], r["std_pop"]] for r in row}
        return PopulationScalerModel(inputCols=cols, fitted=json.dumps(stats),
                                     outputSuffix=self.getOrDefault(self.outputSuffix))


def scaling_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, mean, std_pop) from one aggregate."""
    one = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std_pop")).alias(c) for c in cols])
    return one.unpivot(ids=[], values=cols, variableColumnName="column_name", valueColumnName="s") \
        .select("column_name", "s.mean", "s.std_pop")


def impute_frame(df: DataFrame, num_cols: list[str], cat_cols: list[str]) -> DataFrame:
    """M1+M2 fitted and applied on the same frame."""
    df = ExactMedianImputer(inputCols=num_cols).fit(df).transform(df)
    return ModeImputer(inputCols=cat_cols).fit(df).transform(df)


def category_levels(df: DataFrame, cols: list[str]) -> DataFrame:
    """H3/M4 vocabulary: (column_name, level, level_index, n_rows); index in
    alphabetical order, as ``StringIndexer(stringOrderType='alphabetAsc')``."""
    long = df.select(*cols).unpivot(ids=[], values=cols, variableColumnName="column_name",
                                    valueColumnName="level").where(F.col("level").isNotNull())
    counts = long.groupBy("column_name", "level").agg(F.count(F.lit(1)).alias("n_rows"))
    idx = rank_within(counts, ["column_name"], ["level"], name="level_index")
    return idx.select("column_name", "level", F.col("level_index").cast("int").alias("level_index"), "n_rows")


def encoded_feature_counts(df: DataFrame, num_cols: list[str], cat_cols: list[str]) -> DataFrame:
    """Width of the encoded feature vector, per source column."""
    levels = df.agg(*[F.count_distinct(c).alias(c) for c in cat_cols])
    cat = levels.unpivot(ids=[], values=cat_cols, variableColumnName="column_name", valueColumnName="n_features")
    num = df.sparkSession.createDataFrame([(c, 1) for c in num_cols], "column_name string, n_features long")
    return num.unionByName(cat)


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weight n / (k * n_c) per class (k = number of classes).

    One scan; the totals are taken over the one-row-per-class table.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    every = Window.partitionBy()  # over one row per class
    return counts.select(label, "n_c", (F.sum("n_c").over(every) / (F.count(F.lit(1)).over(every) * F.col("n_c")))
                         .alias("weight"))


def balanced_weights(counts: dict) -> dict:
    """M15 from the class sizes of a fit's rows."""
    n, k = sum(counts.values()), len(counts)
    return {label: n / (k * c) for label, c in counts.items()}


def with_class_weight(df: DataFrame, weights: dict, label: str = LABEL, name: str = "class_weight") -> DataFrame:
    """Attach weights given per class (computed from the rows of a fit) as literals."""
    expr = F.lit(None).cast("double")
    for value, weight in weights.items():
        expr = F.when(F.col(label) == value, F.lit(float(weight))).otherwise(expr)
    return df.withColumn(name, expr)


def test_size(n_c: F.Column, test_fraction: float = 0.2) -> F.Column:
    """Per-class test count: round-half-up of n_c x fraction, in integer arithmetic."""
    share = Fraction(str(test_fraction))
    return F.floor((2 * n_c * share.numerator + share.denominator) / (2 * share.denominator)).cast("bigint")


def stratified_split(df: DataFrame, key: list[str], label: str = LABEL, seed: int = 42,
                     test_fraction: float = 0.2, folds: int = 5) -> DataFrame:
    """M7/M8: add ``split`` ('train'/'test') and ``fold`` (0..folds-1 on train rows).

    Rows of each class are ordered by xxhash64(key, seed) (key breaks hash
    ties); the first round(fraction n_c) are test, the rest are dealt round-robin
    into folds, so fold sizes per class differ by at most one.  Rows without a
    label form a class of their own and are split like any other.
    """
    h = F.xxhash64(*[F.col(k) for k in key], F.lit(seed)).alias("_h")
    ranked = rank_within(df.select("*", h), [label], ["_h", *key], name="_rank", uniform=True)
    sizes = df.groupBy(F.col(label).alias("_label")).agg(
        test_size(F.count(F.lit(1)), test_fraction).alias("_n_test"))
    # one row per class value: a proven-small broadcast
    out = ranked.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_label")))
    is_test = F.col("_rank") < F.col("_n_test")
    return out.select(
        *df.columns,
        F.when(is_test, "test").otherwise("train").alias("split"),
        F.when(is_test, F.lit(None)).otherwise((F.col("_rank") - F.col("_n_test")) % folds)
        .cast("int").alias("fold"))


def one_hot_columns(df: DataFrame, cols: list[str], prefix_sep: str = "_",
                    vocabulary: dict[str, list[str]] | None = None, max_levels: int = 5000) -> DataFrame:
    """H3: dummy 0/1 columns ``<col>_<level>``, the source columns replaced.

    Without ``vocabulary`` every level present gets a column, in alphabetical
    order (get_dummies semantics); the levels are collected first, like
    ``StringIndexer`` does.  More than ``max_levels`` of them, too many for a
    plan with a column each, raise an error and nothing is collected.
    With ``vocabulary`` (e.g. a dimension table's codes) the columns are fixed
    in advance and no collection happens.
    """
    if vocabulary is not None:
        levels = {c: list(vocabulary[c]) for c in cols}
    else:
        levels = {c: [] for c in cols}
        n = df.agg(F.greatest(F.lit(0), *[F.count_distinct(c) for c in cols])).first()[0]
        if n > max_levels:
            raise ValueError(f"{n} levels in one column; name the wanted ones in vocabulary")
        for r in category_levels(df, cols).orderBy("column_name", "level_index").collect():
            levels[r["column_name"]].append(r["level"])
    keep = [F.col(c) for c in df.columns if c not in cols]
    dummies = [F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}{prefix_sep}{v}")
               for c in cols for v in levels[c]]
    return df.select(*keep, *dummies)
