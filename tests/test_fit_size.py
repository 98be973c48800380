"""What a fit's tasks read and what its Python workers hold is bounded by rows, not by the input."""
import random
import threading
import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from penalytics.operators import models as MD
from penalytics.operators.tree_tables import TreeTables
from penalytics.plans import catalog as K

COLUMNS = "facility_id string, state string, measure_name string, number_of_discharges double, predicted_readmission_rate double, " \
          "expected_readmission_rate double, number_of_readmissions double, is_penalized int, fold int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = []
    for i in range(300):
        p, e = rng.uniform(10, 20), rng.uniform(10, 20)
        made.append((f"{i:06d}", rng.choice(["AL", "AK", None]), rng.choice(["COPD", "CABG"]), float(rng.randrange(500)), p, e,
                     float(rng.randrange(90)), int(p + rng.uniform(-2, 2) > e), i % 5))
    return spark.createDataFrame(made, COLUMNS).coalesce(1)


def sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


def seen_by_learners(monkeypatch):
    """The partition sizes and rows of the frames that learners are fitted on."""
    seen, own = [], MD.classifier

    def watched(*args):
        learner = own(*args)
        return SimpleNamespace(fit=lambda df: seen.append((sizes(df), sorted(map(str, df.collect())))) or learner.fit(df))
    monkeypatch.setattr(MD, "classifier", watched)
    return seen


def test_fits_run_on_partitions_of_bounded_rows(monkeypatch, rows):
    seen = seen_by_learners(monkeypatch)
    MD.fit_many(["Decision Tree"], rows)
    monkeypatch.setattr(MD, "FIT_ROWS", 50, raising=False)
    MD.fit_many(["Decision Tree"], rows)
    (small, before), (large, after) = seen
    assert len(small) == 1 and before == after  # few rows stay as they are, and none is lost
    assert len(large) == 6 and max(large) <= 60


@pytest.mark.parametrize("name, fits, fitted", [("Random Forest", 5, 240), ("Support Vector Machine", 20, None)])
def test_folds_are_fitted_on_partitions_of_bounded_rows(monkeypatch, rows, name, fits, fitted):
    seen = seen_by_learners(monkeypatch)
    monkeypatch.setattr(MD, "FIT_ROWS", 50, raising=False)
    assert MD.cross_validate([name], rows, fast=True).count() == 5
    assert len(seen) == fits  # a fold's SVM takes three fits for its calibration and one of all rows
    assert all(max(parts) <= 60 for parts, _ in seen)
    assert fitted is None or all(sum(parts) == fitted for parts, _ in seen)  # no row of the other folds is left out


def test_views_are_kept_in_files_of_bounded_rows(monkeypatch, spark, rows):
    monkeypatch.setattr(MD, "FIT_ROWS", 70, raising=False)
    key = (K._app(spark), "/none", "bounded")
    kept = K._kept(spark, "/none", "bounded", lambda: rows)
    path, _ = K._VIEWS.pop(key)
    files = kept.groupBy(F.input_file_name()).count().collect()
    assert len(files) == 5 and max(r["count"] for r in files) <= 70
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
    K.delete_path(spark, path)


@pytest.mark.parametrize("limit, at_once", [(1 << 20, 5), (700, 2), (10, 1)])
def test_folds_with_the_svm_are_kept_by_rows(monkeypatch, rows, limit, at_once):
    found, own = [], MD._together

    def together(spark, work, items, parallelism=None):
        if items == list(range(5)):
            found.append(parallelism or len(items))
            return [[("x", f, 1.0)] for f in items]
        return own(spark, work, items, parallelism)
    monkeypatch.setattr(MD, "_together", together)
    monkeypatch.setattr(MD, "FOLD_ROWS", limit, raising=False)
    MD.cross_validate(["Support Vector Machine"], rows)
    MD.cross_validate(["Gradient Boosting"], rows)
    assert found == [at_once, 5]


def test_all_fits_of_an_svm_run_at_once(monkeypatch, rows):
    gate, own = threading.Barrier(MD.PLATT_FOLDS + 1), MD.classifier

    def gated(*args):
        learner = own(*args)
        return SimpleNamespace(fit=lambda df: gate.wait(60) is not None and learner.fit(df))
    monkeypatch.setattr(MD, "classifier", gated)
    model = MD.fit_many(["Support Vector Machine"], rows, fast=True)["Support Vector Machine"]
    rff, svm, platt = model.stages[-3:]
    assert svm.coefficients.size == 100 and len(MD.json.loads(platt.getOrDefault("coef"))) == 2


def test_the_longest_fits_start_first_and_few_run_at_once(monkeypatch, rows):
    names, lock, begun, now, most = MD.model_names(), threading.Lock(), [], [0], [0]

    class Learner:
        def __init__(self, name):
            self.name = name

        def fit(self, df):
            with lock:
                begun.append(self.name)
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.3)
            with lock:
                now[0] -= 1
            return MD.PipelineModel([])
    monkeypatch.setattr(MD, "classifier", lambda name, *_: Learner(name))
    monkeypatch.setattr(MD, "_fit_svm", lambda *_: [Learner("Support Vector Machine").fit(None)])
    monkeypatch.setattr(MD, "_as_tables", lambda name, fitted, df: fitted)
    assert list(MD.fit_many(names, rows)) == names  # all of them, in the order asked for
    assert sorted(begun) == sorted(names) and most[0] == 3
    assert set(begun[:3]) == {"Gradient Boosting", "Support Vector Machine", "Random Forest"}


def test_only_test_rows_are_scored_where_only_they_are_read(monkeypatch, spark, rows):
    key, seen = (K._app(spark), "/none"), []
    split = rows.withColumn("row_id", F.col("facility_id").cast("long")).withColumn("split", F.when(F.col("fold") == 0, "test").otherwise("train"))
    monkeypatch.setattr(K, "split_frame", lambda *_: split)
    monkeypatch.setattr(K, "fitted_models", lambda spark, sf_dir, names: dict.fromkeys(names))

    def score(model, df, name):
        seen.append((name, {r["split"] for r in df.select("split").distinct().collect()}))
        return df.select("*", F.lit(name).alias("model"), F.lit(1).alias("prediction"), F.lit(0.75).alias("probability"))
    monkeypatch.setattr(MD, "score", score)
    try:
        for query in (K.q_consensus_fitted, K.q_model_confusion_fitted, K.q_model_report_fitted):
            assert query(spark, "/none").count()
        assert sorted(seen) == sorted((n, {"test"}) for n in MD.model_names())  # and once for all three
        votes = K.q_consensus_fitted(spark, "/none").collect()
        assert len(votes) == 60 and {r["n_models"] for r in votes} == {6}
        assert K.scored_rows(spark, "/none", "Decision Tree").count() == 300  # all rows for who reads all
        assert K.scored_rows(spark, "/none", "Decision Tree", "test").count() == 60 and len(seen) == 7
    finally:
        for k in [k for k in K._SCORED if k[:2] == key]:
            K._SCORED.pop(k).unpersist()


def peak(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_routing_holds_little_besides_its_result():
    rng, trees, depth = np.random.default_rng(1), 100, 6
    per = 2 ** (depth + 1) - 1
    k = np.arange(per)
    inner = k < 2 ** depth - 1
    base = np.arange(trees) * per
    over = lambda a: np.tile(a, trees)
    child = lambda c: np.where(over(inner), over(c) + np.repeat(base, per), 0)
    feature = np.where(over(inner), rng.integers(0, 4, trees * per), -1)
    cut = rng.uniform(0, 1, trees * per)
    tables = TreeTables(base, feature, cut, child(2 * k + 1), child(2 * k + 2), np.ones(trees * per, int), cut, cut)
    x = rng.uniform(0, 1, (5000, 4))
    at, most = peak(lambda: tables.leaves(x))
    assert most < 2.5 * at.nbytes
    for i in (0, 511, 512, 4999):
        for t in range(trees):
            n = base[t]
            while feature[n] >= 0:
                n = tables.left[n] if x[i, feature[n]] <= cut[n] else tables.right[n]
            assert at[i, t] == n
    assert tables.leaves(x[:0]).shape == (0, trees)


def test_fourier_features_are_made_in_place():
    rng = np.random.default_rng(2)
    w, b, x = rng.normal(size=(20, 300)), rng.uniform(size=300), rng.normal(size=(4000, 20))
    rows = pd.Series(list(x))
    project, parts = MD._rff_udf(w, b).func, []

    def longest():
        for part in project(iter([rows, rows[:0], rows[:10]])):
            parts.append(np.stack(part[-3:]))
            yield len(part)
    sizes, most = peak(lambda: list(longest()))
    assert most < 1.6 * len(x) * 300 * 8  # the features once, besides parts of bounded rows
    assert sum(sizes) == 4010 and max(sizes) <= 1 << 10
    want = np.cos(x @ w + b) * np.sqrt(2 / 300)
    assert np.array_equal(parts[0], want[1021:1024]) and np.array_equal(parts[-2], want[3997:])


def test_fourier_features_stay_with_their_rows(spark):
    df = spark.range(2500).coalesce(1).select("id", MD.array_to_vector(F.array(F.col("id") / 1000.0, F.lit(1.0))).alias("features"))
    out = MD.RandomFourierFeatures(inputCol="features", outputCol="rff", numFeatures=3).fit(df).transform(df)
    fitted = MD.json.loads(MD.RandomFourierFeatures(inputCol="features", outputCol="rff", numFeatures=3).fit(df).getOrDefault("weights"))
    got = {r["id"]: r["rff"].toArray() for r in out.select("id", "rff").collect()}
    assert len(got) == 2500
    for i in (0, 1023, 1024, 2499):
        want = np.cos(np.array([i / 1000.0, 1.0]) @ np.array(fitted["w"]) + np.array(fitted["b"])) * np.sqrt(2 / 3)
        assert np.allclose(got[i], want)
