"""Node tables against Spark's own scoring, brute-force trees and plain Newton boosting."""
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array


from penalytics.operators import models as MD
from penalytics.operators import tree_tables as X
from penalytics.plans import catalog as K
from penalytics.session import shared_path
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(300, 3)), 2)
    x[:, 2] = rng.integers(0, 2, 300)
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + 0.7 * rng.normal(size=300)) > 0).astype(float)
    df = spark.createDataFrame([(i, float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))], "i long, label double, a double, b double, c double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).coalesce(2).persist()
    return df, x, y


def scores(frame):
    return {r["i"]: r["p"] for r in frame.select("i", vector_to_array("probability")[1].alias("p")).collect()}


@pytest.mark.parametrize("kind", ["tree", "forest"])
def test_uncut_tables_score_as_the_model(data, kind):
    df, _, _ = data
    learner = DecisionTreeClassifier(maxDepth=8, seed=1) if kind == "tree" else RandomForestClassifier(numTrees=7, maxDepth=6, seed=1)
    model = learner.fit(df)
    mine = X.TreeTablesModel(tables=X.TreeTables.of(X.node_table(model)).encode())
    a, b = scores(model.transform(df)), scores(mine.transform(df))
    assert a == pytest.approx(b, abs=1e-12)
    right = model.transform(df).select("i", "prediction").collect()
    assert {r["i"]: r["prediction"] for r in right} == {r["i"]: r["prediction"] for r in mine.transform(df).select("i", "prediction").collect()}


def test_node_table_counts_its_rows(data):
    df, x, _ = data
    model = DecisionTreeClassifier(maxDepth=8, seed=1).fit(df)
    nodes = {r["node"]: r for r in X.node_table(model).collect()}
    assert nodes[0]["parent"] is None and nodes[0]["n_rows"] == 300
    inner = [r for r in nodes.values() if r["left"] is not None]
    assert all(nodes[r["left"]]["n_rows"] + nodes[r["right"]]["n_rows"] == r["n_rows"] for r in inner)
    assert all(nodes[r["left"]]["parent"] == r["node"] == nodes[r["right"]]["parent"] for r in inner)
    t = X.TreeTables.of(X.node_table(model))
    at, counts = np.unique(t.leaves(x), return_counts=True)
    assert (t.rows[at] == counts).all()


def entropy(y):
    p = y.mean()
    return 0.0 if p in (0, 1) else -(p * np.log2(p) + (1 - p) * np.log2(1 - p))


def grow(x, y, cuts, depth, least_split, least_leaf=5):
    """A plain greedy tree over given cut points: (prediction, share, left, right, feature, cut)."""
    label, share = float(y.mean() > 0.5), y.mean()
    best = None
    if depth and len(y) >= least_split:
        for f, own in enumerate(cuts):
            for c in own:
                go = x[:, f] <= c
                if min(go.sum(), (~go).sum()) >= least_leaf:
                    gain = entropy(y) - go.mean() * entropy(y[go]) - (~go).mean() * entropy(y[~go])
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, f, c
    if best is None or best[0] <= 1e-12:
        return label, share, None, None, None, None
    _, f, c = best
    go = x[:, f] <= c
    left, right = (grow(x[k], y[k], cuts, depth - 1, least_split, least_leaf) for k in (go, ~go))
    if left[2] is None and right[2] is None and left[0] == right[0]:
        return label, share, None, None, None, None
    return label, share, left, right, f, c


def share_at(tree, row):
    while tree[2] is not None:
        tree = tree[2] if row[tree[4]] <= tree[5] else tree[3]
    return tree[1]


@pytest.mark.parametrize("least", [2, 10, 40, 100])
def test_cut_tree_is_the_tree_grown_with_the_rule(spark, least):
    """Few distinct values, so that a plain learner's cut points are Spark's."""
    rng = np.random.default_rng(least)
    x = rng.integers(0, 4, (240, 3)).astype(float)
    y = (x @ [1.0, 0.6, -0.9] + rng.normal(size=240) > 1).astype(float)
    df = spark.createDataFrame([(i, float(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))], "i long, label double, a double, b double, c double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=6, impurity="entropy", minInstancesPerNode=5, seed=1).fit(df)
    whole = X.TreeTables.of(X.node_table(model))
    t = whole.with_min_split(least)
    assert (t.rows[t.feature >= 0] >= least).all()
    assert len(t.feature) < len(whole.feature) or least <= 10
    want = grow(x, y, [[0.5, 1.5, 2.5]] * 3, 6, least)
    assert t.value[t.leaves(x)[:, 0]] == pytest.approx([share_at(want, r) for r in x], abs=1e-12)


def test_forest_trees_are_cut_each(data):
    df, x, _ = data
    whole = X.TreeTables.of(X.node_table(RandomForestClassifier(numTrees=9, maxDepth=9, minInstancesPerNode=2, seed=3).fit(df)))
    t = whole.with_min_split(30, merge_equal=False)
    assert (t.rows[t.feature >= 0] >= 30).all() and len(t.roots) == 9
    deep, at = whole.leaves(x), t.leaves(x)
    up = np.full(len(whole.feature), -1)
    for k in np.flatnonzero(whole.feature >= 0):
        up[whole.left[k]] = up[whole.right[k]] = k
    for tree in range(9):  # each row's leaf is its deepest old node whose parent has 30 rows
        for row in range(0, 300, 17):
            node, path = deep[row, tree], []
            while node >= 0:
                path.append(node)
                node = up[node]
            kept = next(n for n in path if n == whole.roots[tree] or whole.rows[up[n]] >= 30 and all(
                whole.rows[m] >= 30 for m in path[path.index(n) + 1:]))
            assert (t.rows[at[row, tree]], t.value[at[row, tree]]) == (whole.rows[kept], whole.value[kept])


@pytest.mark.parametrize("most_paths", [10_000, 3])
def test_newton_leaves_equal_plain_boosting_and_lower_the_loss(data, most_paths):
    df, x, y = data
    model = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.1, seed=5, minInstancesPerNode=5).fit(df)
    t = X.TreeTables.of(X.node_table(model)).with_min_split(10, merge_equal=False)
    found, start, losses = X.newton_leaves(t, df, 0.1, most_paths=most_paths)
    assert start == pytest.approx(np.log(y.mean() / (1 - y.mean())))
    f, at, want = np.full(300, start), t.leaves(x), []
    for k in range(12):
        want.append(np.mean(np.logaddexp(0, np.where(y > 0.5, -f, f))))
        p = 1 / (1 + np.exp(-f))
        for leaf in np.unique(at[:, k]):
            here = at[:, k] == leaf
            step = (y - p)[here].sum() / (p * (1 - p))[here].sum()
            assert found.value[leaf] == pytest.approx(step, rel=1e-9)
            f[here] += 0.1 * step
    assert losses == pytest.approx(want, rel=1e-9)
    assert all(b <= a for a, b in zip(losses, losses[1:]))
    mine = scores(X.TreeTablesModel(tables=found.encode(), kind="steps", start=start, rate=0.1).transform(df))
    assert [mine[i] for i in range(300)] == pytest.approx(1 / (1 + np.exp(-f)), rel=1e-9)


def test_one_hot_columns_and_saving(spark):
    split = K.split_frame(spark, SF_MID)
    for name, least in MD.MIN_SPLIT.items():
        model = MD.fit_pipeline(name, split.where("split = 'train'"), fast=True)
        t = model.stages[-1].table()
        assert (t.rows[t.feature >= 0] >= least).all() and (t.feature >= 0).any()
        path = shared_path(spark, "t-tables")
        model.write().overwrite().save(path)
        a, b = ({r["row_id"]: r["probability"] for r in MD.score(m, split, name).collect()} for m in (model, PipelineModel.load(path)))
        assert a == b and len(a) == split.count()


def test_wide_categories_are_refused(spark):
    schema = ("tree int, node int, parent int, feature int, threshold double, left_values array<double>, n_categories int, left int, "
              "right int, n_rows long, gain double, impurity double, stats array<double>, prediction double")
    rows = [(0, 0, None, 0, None, [1.0, 2.0], 4, 1, 2, 9, 0.1, 0.5, [4.0, 5.0], 1.0),
            (0, 1, 0, None, None, None, -1, None, None, 4, -1.0, 0.0, [4.0, 0.0], 0.0),
            (0, 2, 0, None, None, None, -1, None, None, 5, -1.0, 0.0, [0.0, 5.0], 1.0)]
    with pytest.raises(ValueError):
        X.TreeTables.of(spark.createDataFrame(rows, schema))
