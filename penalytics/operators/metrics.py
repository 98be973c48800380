"""Evaluation metrics as aggregations over a scored table (SURVEY §2.12, E1-E13;
§2.11 M18-M20; A18-A20; H1/H2/H4; T4/T5).

Input is always a long table (key, model, label, prediction, probability[,
split, fold]); every metric is a grouped aggregate over it, so the cost is one
partial/final aggregation per metric family regardless of the row count.
Exact ROC-AUC and ROC points use ``running_sum`` (range partitions + offsets)
instead of a per-model window that would put a whole model in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import binary_label
from .ordered import running_sum

MODEL = "model"
LABEL = "label"
PRED = "prediction"
PROB = "probability"

# The model registry names, in registry order, with short names.
MODEL_NAMES = [
    ("Logistic Regression", "LR"),
    ("Decision Tree", "DT"),
    ("Support Vector Machine", "SVM"),
    ("Random Forest", "RF"),
    ("Gradient Boosting", "GB"),
    ("Neural Network (MLP)", "MLP"),
]
CLASS_NAMES = ["No Penalty", "Penalty"]


def _cnt(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def _ratio0(n: Column, d: Column) -> Column:
    """n / d with 0 on a zero denominator (zero_division=0)."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, group: list[str]) -> DataFrame:
    y, p = F.col(LABEL), F.col(PRED)
    return df.groupBy(*group).agg(
        _cnt((y == 1) & (p == 1)).alias("tp"), _cnt((y == 0) & (p == 1)).alias("fp"),
        _cnt((y == 0) & (p == 0)).alias("tn"), _cnt((y == 1) & (p == 0)).alias("fn"))


def binary_metrics(df: DataFrame, group: list[str]) -> DataFrame:
    """Accuracy and positive-class precision, recall, F1 (0 on zero division)."""
    c = confusion_counts(df, group)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision = _ratio0(tp, tp + fp)
    recall = _ratio0(tp, tp + fn)
    return c.select(
        *group, "tp", "fp", "tn", "fn", (tp + fp + tn + fn).alias("n"),
        _ratio0(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        _ratio0(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion_matrix(df: DataFrame, group: list[str]) -> DataFrame:
    """2x2 cells per group, rows = actual, zeros kept."""
    c = confusion_counts(df, group)
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(pv).alias("predicted"), F.col(n).alias("n"))
                      for a, pv, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return c.select(*group, F.inline(cells))


def classification_report(df: DataFrame, group: list[str]) -> DataFrame:
    """Per class precision/recall/F1/support, then accuracy, macro and weighted rows."""
    m = confusion_counts(df, group)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    p1, r1 = _ratio0(tp, tp + fp), _ratio0(tp, tp + fn)
    p0, r0 = _ratio0(tn, tn + fn), _ratio0(tn, tn + fp)
    f1_1 = _ratio0(2 * tp, 2 * tp + fp + fn)
    f1_0 = _ratio0(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    acc = _ratio0(tp + tn, n)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class_name"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), s.cast("double").alias("support"))
    rows = F.array(
        row(CLASS_NAMES[0], p0, r0, f1_0, s0),
        row(CLASS_NAMES[1], p1, r1, f1_1, s1),
        row("accuracy", acc, acc, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", _ratio0(p0 * s0 + p1 * s1, n), _ratio0(r0 * s0 + r1 * s1, n),
            _ratio0(f1_0 * s0 + f1_1 * s1, n), n))
    return m.select(*group, F.inline(rows))


def score_counts(df: DataFrame, group: list[str]) -> DataFrame:
    """(group..., score, pos, neg): one row per distinct score."""
    return df.groupBy(*group, F.col(PROB).alias("score")).agg(
        _cnt(F.col(LABEL) == 1).alias("pos"), _cnt(F.col(LABEL) == 0).alias("neg"))


def roc_auc(df: DataFrame, group: list[str]) -> DataFrame:
    """E5: exact ROC-AUC = P(score_pos > score_neg) + 0.5 P(tie) (Mann-Whitney
    with tie-averaged ranks).  NULL when a group has a single class."""
    sc = score_counts(df, group)
    cum = running_sum(sc, group, ["score"], ["neg"])
    below = F.col("cum_neg") - F.col("neg")
    return cum.groupBy(*group).agg(
        F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))).alias("_u"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n")).select(
        *group, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                       F.col("_u") / (F.col("_p") * F.col("_n"))).alias("roc_auc"))


def roc_points(df: DataFrame, group: list[str]) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, plus the origin at
    threshold +inf.  Collinear points are kept."""
    sc = score_counts(df, group).withColumn("neg_score", -F.col("score"))
    cum = running_sum(sc, group, ["neg_score"], ["pos", "neg"])
    totals = sc.groupBy(*group).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    pts = cum.join(totals, group).select(
        *group, F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), F.col("_N").cast("double")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("_P").cast("double")).alias("tpr"))
    origin = totals.select(*group, F.lit(float("inf")).alias("threshold"),
                           F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def cv_summary(df: DataFrame, group: list[str], fold: str = "fold") -> DataFrame:
    """Per-fold accuracy, then mean and population std over folds."""
    per_fold = df.groupBy(*group, fold).agg(F.avg((F.col(PRED) == F.col(LABEL)).cast("double")).alias("acc"))
    return per_fold.groupBy(*group).agg(F.count(F.lit(1)).alias("n_folds"),
                                        F.avg("acc").alias("cv_mean"), F.stddev_pop("acc").alias("cv_std"))


def comparison(df: DataFrame, split: str = "split", fold: str = "fold", cv: DataFrame | None = None) -> DataFrame:
    """The eight-metric table per model (train/test accuracy, test P/R/F1,
    test AUC, CV mean/std) plus E13's train-test gap.  ``cv`` (model, cv_mean, cv_std)
    comes from refits; without it the given predictions are summed up per fold."""
    test = df.where(F.col(split) == "test")
    train = df.where(F.col(split) == "train")
    tm = binary_metrics(test, [MODEL]).select(MODEL, F.col("accuracy").alias("test_accuracy"),
                                               "precision", "recall", "f1")
    tr = train.groupBy(MODEL).agg(F.avg((F.col(PRED) == F.col(LABEL)).cast("double")).alias("train_accuracy"))
    auc = roc_auc(test, [MODEL])
    cv = cv if cv is not None else cv_summary(train, [MODEL], fold).drop("n_folds")
    out = tr.join(tm, MODEL).join(auc, MODEL).join(cv, MODEL)
    return out.select(MODEL, "train_accuracy", "test_accuracy", "precision", "recall", "f1", "roc_auc",
                      "cv_mean", "cv_std",
                      (F.col("train_accuracy") - F.col("test_accuracy")).alias("overfit_gap"))


COMPARISON_METRICS = ["train_accuracy", "test_accuracy", "precision", "recall", "f1", "roc_auc",
                      "cv_mean", "cv_std"]


def metrics_long(comp: DataFrame) -> DataFrame:
    """H1: wide comparison -> (model, metric, value)."""
    return comp.unpivot(ids=[MODEL], values=COMPARISON_METRICS, variableColumnName="metric",
                        valueColumnName="value")


def metrics_by_metric(long: DataFrame) -> DataFrame:
    """H2: transpose, one row per metric and one column per model (short names)."""
    short = F.create_map(*[x for n, s in MODEL_NAMES for x in (F.lit(n), F.lit(s))])
    return (long.withColumn("short", short[F.col(MODEL)])
            .groupBy("metric").pivot("short", [s for _, s in MODEL_NAMES]).agg(F.first("value")))


def best_flags(long: DataFrame) -> DataFrame:
    """H4: flag the largest value of each metric (as the reference highlights
    it, the largest CV std is flagged too).  The window is over the metrics
    table (models x metrics rows)."""
    w = Window.partitionBy("metric")
    return long.withColumn("is_max", F.col("value") == F.max("value").over(w))


def model_order() -> Column:
    return F.create_map(*[x for i, (n, _) in enumerate(MODEL_NAMES) for x in (F.lit(n), F.lit(i))])


def best_model(comp: DataFrame) -> DataFrame:
    """Arg-max of test accuracy, the first model in registry order wins ties."""
    key = F.struct(F.col("test_accuracy"), (-model_order()[F.col(MODEL)]).alias("neg_order"))
    return comp.agg(F.max_by(F.struct(MODEL, "test_accuracy", "roc_auc", "f1"), key).alias("b")).select(
        F.col("b.model").alias("best_model"), F.col("b.test_accuracy").alias("test_accuracy"),
        F.col("b.roc_auc").alias("roc_auc"), F.col("b.f1").alias("f1"))


def model_ranking(comp: DataFrame) -> DataFrame:
    """T4: models by test accuracy (desc), registry order on ties.  The
    comparison table has one row per model, so the unpartitioned window sees
    a handful of rows."""
    w = Window.orderBy(F.col("test_accuracy").desc(), model_order()[F.col(MODEL)])
    return comp.select(MODEL, "test_accuracy", F.row_number().over(w).alias("rank"))


def consensus(votes: DataFrame, key: str = "row_id") -> DataFrame:
    """Penalised iff votes >= n/2; mean probability; 'k/n' agreement."""
    v = votes.groupBy(key).agg(
        F.sum(F.col(PRED)).cast("bigint").alias("n_votes"),
        F.count(F.lit(1)).alias("n_models"),
        F.avg(F.col(PROB)).alias("mean_probability"))
    return v.select(key, "n_votes", "n_models",
                    (F.col("n_votes") >= F.col("n_models") / 2).cast("int").alias("consensus"),
                    binary_label((F.col("n_votes") >= F.col("n_models") / 2).cast("int")).alias("consensus_label"),
                    (F.col("n_votes") / F.col("n_models")).alias("vote_fraction"),
                    "mean_probability",
                    F.concat_ws("/", F.col("n_votes").cast("string"), F.col("n_models").cast("string"))
                    .alias("models_agree"))


def prediction_matrix(votes: DataFrame, key: str = "row_id") -> DataFrame:
    """One row per key with each model's prediction as a column, the
    number of correct models and the agreement class (=6, >=4, else)."""
    cols = []
    for name, short in MODEL_NAMES:
        cols.append(F.max(F.when(F.col(MODEL) == name, F.col(PRED))).alias(short))
    m = votes.groupBy(key).agg(F.first(LABEL).alias("true_label"), *cols,
                               _cnt(F.col(PRED) == F.col(LABEL)).alias("correct_count"))
    n = len(MODEL_NAMES)
    return m.withColumn("agreement", F.when(F.col("correct_count") == n, "all")
                        .when(F.col("correct_count") >= 4, "most").otherwise("split"))
