"""Importance by permutation and Shapley values, against brute force."""
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from penalytics.operators import importance as I
from penalytics.operators import models as MD
from penalytics.operators import shapley as S
from penalytics.operators.tree_tables import TreeTables
from penalytics.plans import catalog as K
from tests.conftest import SF_MID


# ---------------------------------------------------------------- importance

@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=400), rng.normal(size=400)
    data = [(i, float(x), float(y), f"s{i % 7}", int(x > 0)) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(data, "id long, a double, b double, c string, label int").repartition(3)


def by_a(df):
    return df.withColumns({"prediction": (F.col("a") > 0).cast("int"), "probability": 1 / (1 + F.exp(-F.col("a")))})


def test_a_permutation_keeps_the_values_and_the_other_columns(rows):
    before = {r.id: r for r in rows.collect()}
    got = I.permuted(rows, "a", ["id"]).collect()
    assert sorted(r.a for r in got) == sorted(r.a for r in before.values()) and len(got) == 400
    assert all((r.b, r.c, r.label) == (before[r.id].b, before[r.id].c, before[r.id].label) for r in got)
    assert sum(r.a == before[r.id].a for r in got) < 20
    assert {r.id: r.a for r in I.permuted(rows.repartition(5), "a", ["id"]).collect()} == {r.id: r.a for r in got}
    assert {r.id: r.a for r in I.permuted(rows, "a", ["id"], seed="2").collect()} != {r.id: r.a for r in got}


def test_drops_equal_brute_force_and_ignored_columns_lose_nothing(rows):
    got = {r.column_name: r for r in I.importance(rows, ["a", "b", "c"], ["id"], by_a).collect()}
    dealt = by_a(I.permuted(rows, "a", ["id"])).collect()
    right = np.mean([r.label == r.prediction for r in dealt])
    pos, neg = ([r.probability for r in dealt if r.label == y] for y in (1, 0))
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert (got["a"].accuracy, got["a"].roc_auc) == pytest.approx((right, auc))
    assert (got["a"].accuracy_drop, got["a"].roc_auc_drop) == pytest.approx((1 - right, 1 - auc)) and right < 0.7
    for c in ("b", "c"):
        assert (got[c].accuracy_drop, got[c].roc_auc_drop) == (0, 0)


# ---------------------------------------------------------------- Shapley values

def small_tree(rng, depth, n_features, counts=1000):
    """Tables of a random tree; a feature may be cut several times on a path."""
    nodes = []

    def grow(d, rows):
        k = len(nodes)
        nodes.append([-1, 0.0, 0, 0, rows, float(rng.normal())])
        if d and rows >= 4 and rng.random() < 0.9:
            left = int(rng.integers(1, rows))
            nodes[k][:2] = int(rng.integers(n_features)), float(rng.normal())
            nodes[k][2] = grow(d - 1, left)
            nodes[k][3] = grow(d - 1, rows - left)
        return k

    grow(depth, counts)
    f, t, left, right, rows, value = map(np.array, zip(*nodes))
    return TreeTables(np.array([0]), f, t, left, right, rows, value, value)


def expected(t, k, row, known):
    f = t.feature[k]
    if f < 0:
        return t.value[k]
    if f in known:
        return expected(t, t.left[k] if row[f] <= t.threshold[k] else t.right[k], row, known)
    return sum(t.rows[c] / t.rows[k] * expected(t, c, row, known) for c in (t.left[k], t.right[k]))


def enumerated(t, row, n):
    out = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            for s in combinations(others, size):
                w = factorial(size) * factorial(n - size - 1) / factorial(n)
                out[i] += w * (expected(t, 0, row, {*s, i}) - expected(t, 0, row, set(s)))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_values_equal_enumeration_over_all_sets(seed):
    rng = np.random.default_rng(seed)
    t = small_tree(rng, 5, 4)
    x = rng.normal(size=(6, 4))
    explain, base = S.explainer(t)
    got = explain(x)
    assert base == pytest.approx(expected(t, 0, x[0], set()))
    for k, row in enumerate(x):
        assert got[k] == pytest.approx(enumerated(t, row, 4), abs=1e-10)
    assert base + got.sum(axis=1) == pytest.approx(t.value[t.leaves(x)[:, 0]])


@pytest.mark.parametrize("name", ["Decision Tree", "Gradient Boosting"])
def test_contributions_add_up_to_the_score(spark, name):
    split = K.split_frame(spark, SF_MID)
    model = MD.fit_pipeline(name, split.where("split = 'train'"), fast=True)
    columns = [*MD.NUM_FEATURES, *MD.CAT_FEATURES]
    got = S.explain_rows(model, split.select("row_id", *columns), ["row_id"], columns).collect()
    scores = {r.row_id: r.probability for r in MD.score(model, split, name).collect()}
    assert len(got) == 6 * len(scores)
    sums = {}
    for r in got:
        sums.setdefault(r.row_id, [r.base_value, r.model_value])[0] += r.contribution
    for i, (total, value) in sums.items():
        assert total == pytest.approx(value, abs=1e-9)
        p = value if name == "Decision Tree" else 1 / (1 + np.exp(-value))
        assert p == pytest.approx(scores[i], abs=1e-9)


def test_only_tree_tables_can_be_explained(spark):
    split = K.split_frame(spark, SF_MID)
    model = MD.fit_pipeline("Logistic Regression", split, fast=True)
    with pytest.raises(TypeError):
        S.explain_rows(model, split, ["row_id"], [*MD.NUM_FEATURES, *MD.CAT_FEATURES])
