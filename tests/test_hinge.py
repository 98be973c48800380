"""SVMs that share their passes are those of ``LinearSVC``, and no Fourier features are kept for them."""
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from penalytics.operators import hinge as H
from penalytics.operators import models as MD

FOLDS = 3


def made(spark, n, parts=4, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1), rng.gauss(0, 1), float(rng.random() < 0.3)]
        rows.append((x, float(x[0] + x[1] * x[1] + rng.gauss(0, 0.5) > 0.8), 0.5 + rng.random(), i % FOLDS))
    df = spark.createDataFrame(rows, "x array<double>, label double, class_weight double, fold int").repartition(parts)
    return df.select(array_to_vector("x").alias("features"), "label", "class_weight", "fold").persist()


def test_fourier_features_are_cosines():
    rng = np.random.default_rng(4)
    w, b, x = rng.normal(size=(20, 50)), rng.uniform(0, 7, size=50), rng.normal(0, 3, size=(H.CACHED_ROWS, 20))
    ones = np.column_stack([x, np.ones(len(x))])
    cosines = H._fourier(w, b)
    assert np.abs(cosines(ones) - np.cos(x @ w + b)).max() < 1e-12
    assert np.abs(cosines(ones[:7]) - np.cos(x[:7] @ w + b)).max() < 1e-12


@pytest.mark.parametrize("most, tol", [(200, 1e-3), (7, 1e-3), (200, 1e-1)])
def test_fits_are_those_of_linear_svc(spark, monkeypatch, most, tol):
    rows = made(spark, 700)
    rff = MD.RandomFourierFeatures(inputCol="features", outputCol="rff", numFeatures=30).fit(rows)
    p, mapped = MD.json.loads(rff.getOrDefault("weights")), rff.transform(rows).persist()
    learner = MD.LinearSVC(featuresCol="rff", regParam=1 / 7000, maxIter=most, weightCol="class_weight", standardization=False, tol=tol)
    passes, own = [], H._losses
    monkeypatch.setattr(H, "_losses", lambda *a: passes.append(len(a[2])) or own(*a))
    got = H.fit_svms(rows, np.array(p["w"]), np.array(p["b"]), "fold", "class_weight", FOLDS, 1 / 7000, most, tol)
    assert len(got) == 1 + FOLDS
    longest = 0
    for (coefs, intercept), k in zip(got, (None, *range(FOLDS))):
        want = learner.fit(mapped if k is None else mapped.where(F.col("fold") != k))
        longest = max(longest, len(want.summary().objectiveHistory) - 1)
        model = H.svm_model(spark, learner, coefs, intercept)
        assert np.abs(coefs - want.coefficients.toArray()).max() < 1e-5 * np.abs(coefs).max() and intercept == pytest.approx(want.intercept, rel=1e-5)
        assert model.coefficients.size == 30 and model.getMaxIter() == most and model.transform(mapped).where("prediction = label").count() > 560
    assert longest < len(passes) < 2 * longest + 10  # one or two passes a round for all fits together
    assert passes[0] == 1 + FOLDS


def test_sums_take_in_every_row_of_every_part(spark):
    rows = made(spark, 1500, parts=3).coalesce(2)
    rng = np.random.default_rng(1)
    w, b = rng.normal(size=(3, 5)), rng.uniform(size=5)
    cosines = H._fourier(w, b)
    blocks = H._blocks(rows, "fold", "class_weight")
    found = rows.collect()
    x, y, c, f = (np.array([r[k] if k != "features" else r[k].toArray() for r in found]) for k in ("features", "label", "class_weight", "fold"))
    z = np.cos(x @ w + b)
    for merge in (H.DRIVER_PARTS, 1):
        H.DRIVER_PARTS, old = merge, H.DRIVER_PARTS
        try:
            moments = H._moments(blocks, cosines, FOLDS, 5)
            points = rng.normal(size=(2, 6))
            sums = H._losses(blocks, cosines, points, np.array([-1, 1]))
        finally:
            H.DRIVER_PARTS = old
        for k in range(FOLDS):
            own = f == k
            assert np.allclose(moments[k], [c[own].sum(), (c[own] ** 2).sum(), *(c[own] @ z[own]), *(c[own] @ z[own] ** 2)])
        for got, p, out in zip(sums, points, (-1, 1)):
            slack = 1 - (2 * y - 1) * (z @ p[:-1] + p[-1])
            on = c * (slack > 0) * (f != out)
            assert np.allclose(got, [(on * slack).sum(), (-(2 * y - 1) * on).sum(), *((-(2 * y - 1) * on) @ z)])
    blocks.unpersist()


def test_svms_of_many_rows_keep_no_fourier_features(spark, monkeypatch):
    rows = made(spark, 600)
    monkeypatch.setattr(MD, "WEIGHT", "class_weight")
    small = MD._fit_svm(rows, 600, True)
    monkeypatch.setattr(MD, "SHARED_ROWS", 100)
    kept = []
    monkeypatch.setattr(MD.RandomFourierModel, "_transform", lambda *_: kept.append(1))
    rff, svm, platt = MD._fit_svm(rows, 600, True)
    assert not kept and rff.getOrDefault("weights") == small[0].getOrDefault("weights")
    a, b = (np.array(MD.json.loads(p.getOrDefault("coef"))) for p in (small[2], platt))
    assert np.allclose(a, b, rtol=1e-4) and np.allclose(svm.coefficients.toArray(), small[1].coefficients.toArray(), rtol=1e-3, atol=1e-4)


def test_folds_of_many_rows_are_fitted_at_once(spark, monkeypatch):
    found, rows = [], made(spark, 300).select(F.lit(1).alias("is_penalized"), "fold")

    def together(spark, work, items, parallelism=None):
        found.append(parallelism or len(items))
        return [[("x", f, 1.0)] for f in items]
    monkeypatch.setattr(MD, "_together", together)
    monkeypatch.setattr(MD, "FOLD_ROWS", 100)
    for limit in (1000, 100):
        monkeypatch.setattr(MD, "SHARED_ROWS", limit)
        MD.cross_validate(["Support Vector Machine"], rows)
    assert found == [1, 5]  # one at a time where features are kept, else all
