"""The six classifiers as distributed ``pyspark.ml`` pipelines (SURVEY §2.11,
M4-M6, M9-M17).

Preprocessing, fitted on the training rows only and once for all classifiers of a
fit: exact median / mode imputation, population-std scaling, alphabetical string
indexing with an "unknown" slot that one-hot encoding drops (unseen -> zero
vector), vector assembly.  Its numbers and the class sizes come from one job.
Class weights are those of the rows of the fit, so held-out rows don't enter.
Classifiers keep the reference's hyper-parameters where Spark has
them; where Spark has no equivalent the substitute is stated:

* RBF SVM -> random Fourier features (Rahimi & Recht, 2007) + ``LinearSVC``
  + Platt scaling, fitted on the margins of held-out folds.  The projection runs as an Arrow-batched
  pandas UDF (one matrix product per batch).
* MLP with Adam/ReLU/early stopping -> ``MultilayerPerceptronClassifier``
  (sigmoid hidden layers, L-BFGS), same layer sizes and iteration cap.

* The trees' minimum of rows to split a node (10, 5 and 10 for tree, forest and
  boosting) has no Spark parameter; it is kept by cutting the fitted trees
  (``tree_tables``), which is exact for the single tree and the forest.  Boosted
  trees get Newton steps for the log loss at their leaves, as the reference's do.

Every fit is a series of distributed jobs over the persisted training frame;
iterative learners checkpoint to the shared checkpoint folder.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from ..functions.scalar import sigmoid
from .clean import DISCHARGES, EXPECTED, LABEL, MEASURE, PREDICTED, READMISSIONS, STATE
from .features import ImputerModelExact, PopulationScalerModel, balanced_weights, with_class_weight
from .hinge import fit_svms, svm_model
from .metrics import MODEL_NAMES
from .ordered import exact_median
from .tree_tables import TreeTables, TreeTablesModel, newton_leaves, node_table

NUM_FEATURES = [DISCHARGES, PREDICTED, EXPECTED, READMISSIONS]
CAT_FEATURES = [STATE, MEASURE]
WEIGHT = "class_weight"
SEED = 42
# Convergence tolerances: the reference's estimators run with sklearn's default
# tolerances (LogisticRegression and MLPClassifier 1e-4, SVC 1e-3); Spark's own
# default (1e-6) would iterate to the cap.  GBT has no tolerance (all rounds run).
# Memory for a tree level's statistics: a level is then found in one pass.
TREE_MEMORY_MB = 512
# Rows of a partition of the frame that classifiers are fitted on; a smaller frame stays as it is.
FIT_ROWS = 1 << 15
# Rows of the folds of a cross-validation that are mapped for the SVM (300 doubles each) at once.
FOLD_ROWS = 1 << 20
# Rows of Fourier features that a worker hands on at once.
MAPPED_ROWS = 1 << 10
# Rows up to which an SVM's Fourier features are kept for its fits; those of more rows are made anew in passes that the
# fits share: four sets of 300 doubles a row neither fit the memory nor are read fast.
SHARED_ROWS = 1 << 15
# Folds whose held-out margins calibrate the SVM.
PLATT_FOLDS = 3
# Classifiers by the length of their chain of jobs, longest first, and how many of them are fitted at once: with more
# of them, each short job of boosting waits for cores that the long tasks of forest and network hold.
LONGEST_FIRST = ["Gradient Boosting", "Support Vector Machine", "Random Forest", "Neural Network (MLP)",
                 "Logistic Regression", "Decision Tree"]
FITS_AT_ONCE = 3
# Rows that a node needs to be split.
MIN_SPLIT = {"Decision Tree": 10, "Random Forest": 5, "Gradient Boosting": 10}
BOOSTING_RATE = 0.1
SKLEARN_TOL = {"lr": 1e-4, "svm": 1e-3, "mlp": 1e-4}


# ---------------------------------------------------------------- random Fourier features

class _RffParams(Params):
    inputCol = Param(Params._dummy(), "inputCol", "input vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output vector column", TypeConverters.toString)
    numFeatures = Param(Params._dummy(), "numFeatures", "number of random features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "fitted projection (JSON)", TypeConverters.toString)


def _rff_udf(w: np.ndarray, b: np.ndarray):
    scale, part = math.sqrt(2.0 / w.shape[1]), MAPPED_ROWS

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, w.shape[0]))
            z = x @ w  # one array of a batch's features, changed in place and handed on in parts
            z += b
            np.cos(z, out=z)
            z *= scale
            for k in range(0, len(z), part):
                yield pd.Series(list(z[k:k + part]))
    return project


class RandomFourierModel(Model, _RffParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, numFeatures=None, seed=None, weights=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = json.loads(self.getOrDefault(self.weights))
        udf = _rff_udf(np.asarray(p["w"]), np.asarray(p["b"]))
        arr = vector_to_array(F.col(self.getOrDefault(self.inputCol)))
        return dataset.withColumn(self.getOrDefault(self.outputCol), array_to_vector(udf(arr)))


class RandomFourierFeatures(Estimator, _RffParams, DefaultParamsReadable, DefaultParamsWritable):
    """Map x to sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi), with
    gamma = 1 / (d * Var(X)) ("scale"), Var over all entries of X."""

    @keyword_only
    def __init__(self, inputCol="features", outputCol="rff", numFeatures=300, seed=SEED):
        super().__init__()
        self._setDefault(numFeatures=300, seed=SEED)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RandomFourierModel:
        col = self.getOrDefault(self.inputCol)
        s = dataset.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(col)).alias("s")) \
            .first()["s"]
        mean = np.asarray(s["mean"].toArray())
        n = float(s["count"])
        var_pop = np.asarray(s["variance"].toArray()) * ((n - 1) / n if n > 1 else 0.0)
        total_var = float(np.mean(var_pop + mean ** 2) - np.mean(mean) ** 2)
        d = mean.shape[0]
        gamma = 1.0 / (d * total_var) if total_var > 0 else 1.0
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        D = self.getOrDefault(self.numFeatures)
        w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(d, D))
        b = rng.uniform(0.0, 2.0 * math.pi, size=D)
        return RandomFourierModel(inputCol=col, outputCol=self.getOrDefault(self.outputCol),
                                  numFeatures=D, seed=self.getOrDefault(self.seed),
                                  weights=json.dumps({"w": w.tolist(), "b": b.tolist(), "gamma": gamma}))


# ---------------------------------------------------------------- Platt scaling

class _PlattParams(Params):
    rawPredictionCol = Param(Params._dummy(), "rawPredictionCol", "margin vector", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    coef = Param(Params._dummy(), "coef", "fitted [a, b]", TypeConverters.toString)


class PlattModel(Model, _PlattParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, rawPredictionCol=None, labelCol=None, coef=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        a, b = json.loads(self.getOrDefault(self.coef))
        margin = vector_to_array(F.col(self.getOrDefault(self.rawPredictionCol)))[1]
        p1 = sigmoid(F.lit(a) * margin + F.lit(b))
        return dataset.withColumn("probability", array_to_vector(F.array(1 - p1, p1)))


class PlattScaling(Estimator, _PlattParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fit P(y=1 | margin) = sigmoid(a * margin + b) with a 1-D logistic regression."""

    @keyword_only
    def __init__(self, rawPredictionCol="rawPrediction", labelCol="label"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PlattModel:
        raw = self.getOrDefault(self.rawPredictionCol)
        lab = self.getOrDefault(self.labelCol)
        m = dataset.select(array_to_vector(F.array(vector_to_array(F.col(raw))[1])).alias("_m"), F.col(lab))
        lr = LogisticRegression(featuresCol="_m", labelCol=lab, regParam=0.0, maxIter=100,
                                standardization=False).fit(m)
        return PlattModel(rawPredictionCol=raw, labelCol=lab,
                          coef=json.dumps([float(lr.coefficients[0]), float(lr.intercept)]))


# ---------------------------------------------------------------- preprocessing

@dataclass
class FitFacts:
    """What a fit needs to know of its rows: a few numbers per column, level and class."""

    medians: dict[str, float]
    moments: dict[str, tuple[int, float, float]]  # non-null count, mean, population variance
    levels: dict[str, dict[str, int]]
    classes: dict[float, int]

    @property
    def rows(self) -> int:
        return sum(self.classes.values())


def fit_facts(train: DataFrame, num_cols: list[str], cat_cols: list[str], label: str = "label") -> FitFacts:
    """Medians, moments, category levels and class sizes, in one job.

    The result has a row per numeric column and figure, category level and class;
    like ``StringIndexer``, the driver holds the vocabulary.
    """
    schema = "kind", "name", "text", "value"
    parts = [train.groupBy(F.col(label).cast("string").alias("text")).agg(F.count(F.lit(1)).cast("double").alias("value"))
             .select(F.lit("class").alias("kind"), F.lit("").alias("name"), "text", "value")]
    if num_cols:
        parts.append(exact_median(train, num_cols).select(
            F.lit("median").alias("kind"), F.col("column_name").alias("name"), F.lit("").alias("text"),
            F.col("median").alias("value")))
        one = train.agg(*[F.array(*[F.struct(F.lit(c).alias("name"), F.lit(k).alias("text"), v.cast("double").alias("value"))
                                    for k, v in (("count", F.count(c)), ("mean", F.avg(c)), ("var", F.var_pop(c)))]).alias(c)
                          for c in num_cols])
        parts.append(one.select(F.inline(F.concat(*[F.col(c) for c in num_cols])))
                     .select(F.lit("moment").alias("kind"), "name", "text", "value"))
    if cat_cols:
        long = train.select(*[F.col(c).cast("string").alias(c) for c in cat_cols]).unpivot(
            ids=[], values=cat_cols, variableColumnName="name", valueColumnName="text").where("text is not null")
        parts.append(long.groupBy("name", "text").agg(F.count(F.lit(1)).cast("double").alias("value"))
                     .select(F.lit("level").alias("kind"), "name", "text", "value"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    facts, moments = FitFacts({}, {}, {c: {} for c in cat_cols}, {}), {c: {} for c in num_cols}
    for r in every.select(*schema).collect():
        if r["kind"] == "class":
            facts.classes[float(r["text"])] = int(r["value"])
        elif r["kind"] == "median":
            facts.medians[r["name"]] = r["value"]
        elif r["kind"] == "moment":
            moments[r["name"]][r["text"]] = r["value"]
        else:
            facts.levels[r["name"]][r["text"]] = int(r["value"])
    facts.moments = {c: (int(m["count"] or 0), m["mean"], m["var"]) for c, m in moments.items()}
    return facts


def fit_preprocessing(train: DataFrame, num_cols: list[str] = NUM_FEATURES, cat_cols: list[str] = CAT_FEATURES
                      ) -> tuple[list, FitFacts]:
    """M1-M5 fitted on ``train`` (with a double ``label``): the stages, and the facts they came from."""
    facts = fit_facts(train, num_cols, cat_cols)
    scaled = {}
    for c in num_cols:
        n, mean, var = facts.moments[c]
        fill, total = facts.medians.get(c), facts.rows
        if n == 0 or total == 0:
            scaled[c] = [0.0, 1.0]
            continue
        # mean and variance of the imputed column follow from those of its values
        miss = total - n
        center = (n * mean + miss * fill) / total
        spread = (n * (var + (mean - center) ** 2) + miss * (fill - center) ** 2) / total
        scaled[c] = [center, math.sqrt(spread)]
    modes = {c: min(v, key=lambda t: (-v[t], t)) if v else None for c, v in facts.levels.items()}
    stages = [ImputerModelExact(inputCols=num_cols, fitted=json.dumps({c: facts.medians.get(c) for c in num_cols})),
              ImputerModelExact(inputCols=cat_cols, fitted=json.dumps(modes)),
              PopulationScalerModel(inputCols=num_cols, fitted=json.dumps(scaled), outputSuffix="_scaled")]
    vec = [c + "_vec" for c in cat_cols]
    if cat_cols:
        idx = [c + "_idx" for c in cat_cols]
        # one model per column: a table of labels for several would be padded with nulls
        indexers = [StringIndexerModel.from_labels(sorted(facts.levels[c]), inputCol=c, outputCol=i, handleInvalid="keep")
                    for c, i in zip(cat_cols, idx)]
        shown = PipelineModel([*stages, *indexers]).transform(train)
        # the widths are in the indexed columns' metadata: fitting the encoder runs no job
        encoder = OneHotEncoder(inputCols=idx, outputCols=vec, dropLast=True, handleInvalid="keep").fit(shown)
        stages += [*indexers, encoder]
    stages.append(VectorAssembler(inputCols=[c + "_scaled" for c in num_cols] + vec, outputCol="features",
                                  handleInvalid="keep"))
    return stages, facts


# ---------------------------------------------------------------- registry

def classifier(name: str, n_train: int, n_features: int, fast: bool = False):
    """The reference's hyper-parameters mapped to Spark's (``fast`` shrinks the
    iteration / tree counts for smoke tests only)."""
    if name == "Logistic Regression":
        # sklearn: C * sum(w_i loss_i) + |b|^2 / 2  ==  Spark: mean_w(loss) + reg/2 |b|^2 with reg = 1/(C sum w)
        return LogisticRegression(maxIter=100 if fast else 2000, regParam=1.0 / (1.0 * n_train),
                                  elasticNetParam=0.0, standardization=False, weightCol=WEIGHT,
                                  family="binomial", tol=SKLEARN_TOL["lr"])
    if name == "Decision Tree":
        return DecisionTreeClassifier(maxDepth=25, impurity="entropy", minInstancesPerNode=5, seed=SEED,
                                      cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=TREE_MEMORY_MB)
    if name == "Support Vector Machine":
        return LinearSVC(featuresCol="rff", regParam=1.0 / (10.0 * n_train), maxIter=50 if fast else 200,
                         weightCol=WEIGHT, standardization=False, tol=SKLEARN_TOL["svm"])
    if name == "Random Forest":
        return RandomForestClassifier(numTrees=20 if fast else 200, maxDepth=20, minInstancesPerNode=2,
                                      featureSubsetStrategy="sqrt", seed=SEED, cacheNodeIds=True,
                                      checkpointInterval=10, maxMemoryInMB=TREE_MEMORY_MB)
    if name == "Gradient Boosting":
        return GBTClassifier(maxIter=15 if fast else 150, stepSize=BOOSTING_RATE, maxDepth=5, subsamplingRate=0.8,
                             minInstancesPerNode=5, seed=SEED, checkpointInterval=10, maxMemoryInMB=TREE_MEMORY_MB)
    if name == "Neural Network (MLP)":
        return MultilayerPerceptronClassifier(layers=[n_features, 100, 50, 25, 2],
                                              maxIter=50 if fast else 500, seed=SEED, solver="l-bfgs",
                                              tol=SKLEARN_TOL["mlp"])
    raise KeyError(name)


def model_names() -> list[str]:
    return [n for n, _ in MODEL_NAMES]


def short_name(name: str) -> str:
    return dict(MODEL_NAMES)[name]


def labelled(df: DataFrame) -> DataFrame:
    """Rows with a label, which learners need as a double."""
    return df.withColumn("label", F.col(LABEL).cast("double")).where(F.col("label").isNotNull())


def _fit_svm(prepared: DataFrame, n_train: int, fast: bool, folds: int = PLATT_FOLDS) -> list:
    """Fourier features, the SVM of all rows, and Platt scaling on margins of rows not fitted on.

    Up to ``SHARED_ROWS`` rows their Fourier features are kept and ``LinearSVC`` is fitted on them;
    the fits of more rows share passes, which make the features anew (``hinge``).
    """
    rff = RandomFourierFeatures(inputCol="features", outputCol="rff", numFeatures=100 if fast else 300).fit(prepared)
    # equal rows share a fold, so no copy of a held-out row is fitted on
    placed = prepared.withColumn("_platt", F.pmod(F.xxhash64(vector_to_array("features")), F.lit(folds)))
    if n_train > SHARED_ROWS:
        return _fit_svm_shared(rff, placed, n_train, fast, folds)
    mapped = rff.transform(placed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        def fitted(f: int | None):
            """The SVM of all rows, or the margins of a fold's rows by the SVM of the others."""
            own = classifier("Support Vector Machine", n_train, 0, fast)
            if f is None:
                return own.fit(mapped)
            part = own.fit(mapped.where(F.col("_platt") != f))
            return part.transform(mapped.where(F.col("_platt") == f)).select("rawPrediction", "label")

        svm, margins, *others = _together(prepared.sparkSession, fitted, [None, *range(folds)])
        for other in others:
            margins = margins.unionByName(other)
        platt = PlattScaling(rawPredictionCol="rawPrediction", labelCol="label").fit(margins)
    finally:
        mapped.unpersist()
    return [rff, svm, platt]


def _fit_svm_shared(rff: RandomFourierModel, placed: DataFrame, n_train: int, fast: bool, folds: int) -> list:
    """``_fit_svm`` of many rows."""
    own, fourier = classifier("Support Vector Machine", n_train, 0, fast), json.loads(rff.getOrDefault(rff.weights))
    w, b = np.asarray(fourier["w"]), np.asarray(fourier["b"])
    every, *held = fit_svms(placed, w, b, "_platt", WEIGHT, folds, own.getRegParam(), own.getMaxIter(), own.getTol())
    coefs, starts = np.array([c for c, _ in held]), np.array([i for _, i in held])
    scale, part = math.sqrt(2.0 / w.shape[1]), MAPPED_ROWS

    @F.pandas_udf(T.DoubleType())
    def margin(xs: pd.Series, fold: pd.Series) -> pd.Series:
        x, at, out = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, len(w))), fold.to_numpy(), np.zeros(len(xs))
        for k in range(0, len(x), part):
            f = at[k:k + part]
            out[k:k + part] = (scale * np.cos(x[k:k + part] @ w + b) * coefs[f]).sum(axis=1) + starts[f]
        return pd.Series(out)

    # by the SVM of the other folds' rows
    margins = placed.select("label", margin(vector_to_array("features"), F.col("_platt")).alias("_margin"))
    margins = margins.select(array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))).alias("rawPrediction"), "label")
    platt = PlattScaling(rawPredictionCol="rawPrediction", labelCol="label").fit(margins)
    return [rff, svm_model(placed.sparkSession, own, *every), platt]


def _as_tables(name: str, fitted, prepared: DataFrame) -> TreeTablesModel:
    """A fitted tree model with the reference's rules that Spark's learner lacks."""
    boosted = name == "Gradient Boosting"
    tables = TreeTables.of(node_table(fitted)).with_min_split(MIN_SPLIT[name], merge_equal=not boosted)
    if not boosted:
        return TreeTablesModel(tables=tables.encode(), kind="shares")
    tables, start, _ = newton_leaves(tables, prepared, BOOSTING_RATE)
    return TreeTablesModel(tables=tables.encode(), kind="steps", start=start, rate=BOOSTING_RATE)


def _together(spark, work, items: list, parallelism: int | None = None) -> list:
    """Run small chains of jobs from a thread pool, as ``CrossValidator(parallelism=...)`` does."""
    with ThreadPoolExecutor(max_workers=parallelism or max(1, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def spread(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """``df`` of ``rows`` rows in partitions of about ``most`` rows (``FIT_ROWS``) or fewer, dealt out in turn: a
    small file holds many rows, and a learner's task reads its partition anew in every round."""
    most = most or FIT_ROWS
    return df.repartition(-(-rows // most)) if rows > most else df


def fit_many(names: list[str], train: DataFrame, fast: bool = False, parallelism: int | None = None,
             exclude_features: tuple[str, ...] = ()) -> dict[str, PipelineModel]:
    """Fit registry models on the same training rows.

    Preprocessing is fitted once and one prepared frame (label, weight, features)
    is kept for all classifiers (memory, spilling to disk; a lost executor means
    recomputing its blocks); up to ``FIT_ROWS`` rows its partitions are those of the
    input, more rows are spread over partitions of that size.  The classifiers' jobs
    interleave on the executors, those of ``parallelism`` (``FITS_AT_ONCE``) classifiers
    at once; the one with the longest chain of jobs starts first.
    ``exclude_features`` leaves columns out, for instance those that give the
    label away.
    """
    num = [c for c in NUM_FEATURES if c not in exclude_features]
    cat = [c for c in CAT_FEATURES if c not in exclude_features]
    train = labelled(train)
    pre, facts = fit_preprocessing(train, num, cat)
    weighted = with_class_weight(train, balanced_weights(facts.classes), "label", WEIGHT)
    prepared = PipelineModel(pre).transform(weighted).select("label", WEIGHT, "features")
    n_features = prepared.schema["features"].metadata["ml_attr"]["num_attrs"]
    prepared = spread(prepared, facts.rows).persist(StorageLevel.MEMORY_AND_DISK)

    def one(name: str) -> PipelineModel:
        if name == "Support Vector Machine":
            own = _fit_svm(prepared, facts.rows, fast)
        else:
            own = [classifier(name, facts.rows, n_features, fast).fit(prepared)]
            if name in MIN_SPLIT:
                own = [_as_tables(name, own[0], prepared)]
        return PipelineModel(stages=[*pre, *own])

    try:
        order = sorted(names, key=LONGEST_FIRST.index)
        fitted = dict(zip(order, _together(train.sparkSession, one, order, parallelism or FITS_AT_ONCE)))
        return {name: fitted[name] for name in names}
    finally:
        prepared.unpersist()


def fit_pipeline(name: str, train: DataFrame, fast: bool = False, **options) -> PipelineModel:
    """One registry model on the training rows."""
    return fit_many([name], train, fast, **options)[name]


def positive_probability(scored: DataFrame) -> Column:
    """Element 1 of the probability vector; for a model without one, the sigmoid of its margin."""
    if "probability" in scored.columns:
        return vector_to_array(F.col("probability"))[1]
    return sigmoid(vector_to_array(F.col("rawPrediction"))[1])


def score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Label and P(class 1) for every row."""
    out = model.transform(df)
    return out.select(*[c for c in df.columns],
                      F.lit(name).alias("model"),
                      F.col("prediction").cast("int").alias("prediction"),
                      positive_probability(out).alias("probability"))


def fit_and_score(name: str, split_df: DataFrame, fast: bool = False) -> DataFrame:
    """Fit on split == 'train', score every row (train and test)."""
    model = fit_pipeline(name, split_df.where(F.col("split") == "train"), fast)
    return score(model, split_df, name)


def cross_validate(names: list[str], folded: DataFrame, folds: int = 5, fast: bool = False) -> DataFrame:
    """M8: refit on k-1 folds, score the held-out fold, for every named model.

    Preprocessing and weights are fitted once per fold, for all models.  The folds are
    fitted at once, but where the SVM's Fourier features are kept only as many as hold
    ``FOLD_ROWS`` rows.  Returns (model, fold, accuracy): one row per model and
    fold, computed eagerly.
    """
    data = folded.where(F.col(LABEL).isNotNull() & F.col("fold").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)

    def one(f: int) -> list[tuple]:
        models = fit_many(names, data.where(F.col("fold") != f), fast)
        held, every = data.where(F.col("fold") == f).select(LABEL, *NUM_FEATURES, *CAT_FEATURES), None
        for n, m in models.items():
            part = score(m, held, n).select("model", (F.col("prediction") == F.col(LABEL)).cast("double").alias("right"))
            every = part if every is None else every.unionByName(part)
        return [(r["model"], f, r["accuracy"]) for r in every.groupBy("model").agg(F.avg("right").alias("accuracy")).collect()]

    try:
        rows = data.count()
        kept = "Support Vector Machine" in names and rows <= SHARED_ROWS
        at_once = max(1, min(folds, FOLD_ROWS // max(1, rows))) if kept else folds
        rows = [r for part in _together(data.sparkSession, one, list(range(folds)), at_once) for r in part]
    finally:
        data.unpersist()
    return folded.sparkSession.createDataFrame(rows, "model string, fold int, accuracy double")
