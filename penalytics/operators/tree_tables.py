"""Fitted tree models as node tables: rules Spark's learners don't have.

``node_table`` gives the nodes of a fitted ``pyspark.ml`` tree model as rows. ``TreeTables``
holds them as arrays, by which two rules of the reference's learners are kept:

* a minimum of rows to split a node. A learner with that rule grows the same nodes as one
  without it, but for those below a node that it doesn't split: nodes grow independently.
  So cutting such nodes off a fitted tree gives just the tree that the rule would have
  grown (``with_min_split``), for a single tree and for each bagged one. Of boosted trees
  the later ones were fitted to what the uncut ones left over.
* leaf values of boosted trees by a Newton step for the log loss (``newton_leaves``): rows
  are routed to the leaves of all rounds once; then, round by round, gradients and
  curvatures are summed for each leaf, and the leaf's step is their ratio.

``TreeTablesModel`` scores with such tables, all trees and a batch of rows at once, and is
saved and loaded with its pipeline. Like Spark's own tree models it holds the nodes on the driver.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import sigmoid
from ..session import delete_path, shared_path

#: Distinct rows of leaves (two bytes a round) that the driver takes for Newton steps: some 20 MB.
MOST_PATHS = 1 << 16
#: Rows of a batch that are routed through all trees at once.
ROUTED_ROWS = 512


def node_table(model) -> DataFrame:
    """(tree, node, parent, feature, threshold, left_values, n_categories, left, right, n_rows, gain, impurity, stats, prediction)
    of a fitted single tree, forest or boosted trees; parent, left and right are null where there is none.

    ``n_rows`` counts a bagged row as often as it was drawn, without weights.
    """
    spark = SparkSession.active()
    path = shared_path(spark, "tree-model")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    if "nodeData" in rows.columns:
        rows = rows.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        rows = rows.withColumn("tree", F.lit(0))
    some = lambda c: F.when(F.col(c) >= 0, F.col(c))
    nodes = rows.select(
        "tree", F.col("id").alias("node"), some("split.featureIndex").alias("feature"),
        F.when(F.col("split.numCategories") == -1, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(F.col("split.numCategories") >= 0, F.col("split.leftCategoriesOrThreshold")).alias("left_values"),
        F.col("split.numCategories").alias("n_categories"), some("leftChild").alias("left"), some("rightChild").alias("right"),
        F.col("rawCount").alias("n_rows"), "gain", "impurity", F.col("impurityStats").alias("stats"), "prediction")
    up = nodes.where("left is not null").select(F.col("tree").alias("_t"), F.col("node").alias("parent"), F.explode(F.array("left", "right")).alias("_n"))
    found = nodes.join(up, (F.col("tree") == F.col("_t")) & (F.col("node") == F.col("_n")), "left").drop("_t", "_n")
    found = found.select("tree", "node", "parent", *nodes.columns[2:])
    # the model is on the driver anyway, and its table is as small
    held = spark.createDataFrame(found.collect(), found.schema)
    delete_path(spark, path)
    return held


@dataclass(frozen=True)
class TreeTables:
    """Nodes of all trees, one after another. A leaf's feature is -1; ``value`` is a node's share of
    class 1, or its step in a boosted model."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rows: np.ndarray
    value: np.ndarray
    label: np.ndarray

    @staticmethod
    def of(nodes: DataFrame) -> TreeTables:
        """From ``node_table`` rows. Categories are those of 0/1 columns: other sets of categories have no threshold."""
        n = nodes.orderBy("tree", "node").toPandas()
        base = n.groupby("tree").cumcount().to_numpy()
        first = np.flatnonzero(base == 0)
        offset = np.repeat(first, np.diff([*first, len(n)]))
        if not (base == n["node"].to_numpy()).all():
            raise ValueError("nodes of a tree must be numbered from 0")
        leaf = n["left"].isna().to_numpy()
        left, right = ((np.where(leaf, 0, n[c].fillna(0).to_numpy().astype(np.int64)) + offset) for c in ("left", "right"))
        cut = n["threshold"].to_numpy(float, na_value=np.nan)
        if ((n["n_categories"] > 2) & ~leaf).any():
            raise ValueError("a category of more than two values can't be cut by a threshold")
        for k in np.flatnonzero((n["n_categories"].to_numpy() >= 0) & ~leaf):
            cut[k] = 0.5
            if list(n["left_values"].iloc[k]) == [1.0]:  # ones go left
                left[k], right[k] = right[k], left[k]
        stats = n["stats"].to_list()
        share = np.array([s[1] / (s[0] + s[1]) if len(s) == 2 and s[0] + s[1] else p for s, p in zip(stats, n["prediction"])], float)
        return TreeTables(first, np.where(leaf, -1, n["feature"].fillna(-1).to_numpy().astype(np.int64)), cut, left, right,
                          n["n_rows"].to_numpy(np.int64), share, n["prediction"].to_numpy(float))

    @property
    def tree_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.roots)), np.diff([*self.roots, len(self.feature)]))

    def with_min_split(self, rows: int, merge_equal: bool = True) -> TreeTables:
        """Nodes of fewer rows than ``rows`` are leaves. ``merge_equal``: so is, as in Spark's
        classifiers, a node whose two children are leaves with one prediction."""
        feature = np.where(self.rows < rows, -1, self.feature)
        if merge_equal:
            for k in range(len(feature) - 1, -1, -1):  # children stand behind their parent
                a, b = self.left[k], self.right[k]
                if feature[k] >= 0 and feature[a] < 0 and feature[b] < 0 and self.label[a] == self.label[b]:
                    feature[k] = -1
        return replace(self, feature=feature).compact()

    def compact(self) -> TreeTables:
        """Without nodes that no row can reach."""
        seen = np.zeros(len(self.feature), bool)
        front = self.roots
        while len(front):
            seen[front] = True
            inner = front[self.feature[front] >= 0]
            front = np.concatenate((self.left[inner], self.right[inner]))
        new = np.cumsum(seen) - 1
        child = lambda c: np.where(self.feature[seen] >= 0, new[c[seen]], 0)
        return TreeTables(new[self.roots], self.feature[seen], self.threshold[seen], child(self.left), child(self.right),
                          self.rows[seen], self.value[seen], self.label[seen])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row (in any order) and tree."""
        return self.router()(x)

    def router(self):
        """``leaves`` as a function of arrays alone, which workers can run without this package.
        A batch is routed by ``ROUTED_ROWS`` rows: a worker's memory follows these, not rows times trees."""
        roots, feature, threshold, left, right, block = self.roots, self.feature, self.threshold, self.left, self.right, ROUTED_ROWS

        def route_block(x):
            at = np.broadcast_to(roots, (len(x), len(roots))).copy()
            row = np.arange(len(x))[:, None]
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    return at
                down = np.where(x[row, np.maximum(f, 0)] <= threshold[at], left[at], right[at])
                at = np.where(inner, down, at)

        def route(x):
            at = np.empty((len(x), len(roots)), np.int64)
            for k in range(0, len(x), block):
                at[k:k + block] = route_block(x[k:k + block])
            return at
        return route

    def encode(self) -> str:
        out = io.BytesIO()
        np.savez_compressed(out, **self.__dict__)
        return base64.b64encode(out.getvalue()).decode()

    @staticmethod
    def decode(text: str) -> TreeTables:
        with np.load(io.BytesIO(base64.b64decode(text))) as z:
            return TreeTables(**{k: z[k] for k in z.files})


# ---------------------------------------------------------------- scoring

class TreeTablesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """``shares``: the mean of the trees' class-1 shares. ``steps``: the logistic function of
    ``start`` and the steps added up, each times ``rate``."""

    tables = Param(Params._dummy(), "tables", "nodes (encoded arrays)", TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "shares or steps", TypeConverters.toString)
    start = Param(Params._dummy(), "start", "margin before the first step", TypeConverters.toFloat)
    rate = Param(Params._dummy(), "rate", "weight of a step", TypeConverters.toFloat)
    inputCol = Param(Params._dummy(), "inputCol", "feature vector", TypeConverters.toString)

    @keyword_only
    def __init__(self, tables=None, kind="shares", start=0.0, rate=1.0, inputCol="features"):
        super().__init__()
        self._setDefault(kind="shares", start=0.0, rate=1.0, inputCol="features")
        self._set(**self._input_kwargs)

    def table(self) -> TreeTables:
        return TreeTables.decode(self.getOrDefault(self.tables))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held, rate, start = self.table(), self.getOrDefault(self.rate), self.getOrDefault(self.start)
        route, values = held.router(), held.value
        steps = self.getOrDefault(self.kind) == "steps"

        @F.pandas_udf("double")
        def value(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for xs in batches:
                x = np.stack(xs.to_numpy()) if len(xs) else np.zeros((0, 1))
                v = values[route(x)] if len(xs) else np.zeros((0, 1))
                yield pd.Series(start + rate * v.sum(axis=1) if steps else v.mean(axis=1))

        out = dataset.withColumn("_tree_value", value(vector_to_array(F.col(self.getOrDefault(self.inputCol)))))
        v = F.col("_tree_value")
        p = sigmoid(v) if steps else v
        raw = [-v, v] if steps else [1 - v, v]
        return out.select(*dataset.columns, array_to_vector(F.array(*raw)).alias("rawPrediction"),
                          array_to_vector(F.array(1 - p, p)).alias("probability"),
                          (raw[1] > raw[0]).cast("double").alias("prediction"))


# ---------------------------------------------------------------- Newton steps

def _round_sums(start: float, rate: float, values: list[np.ndarray], size: int):
    """Sums over rows (label, leaves of all rounds, times) for the round after those with ``values``:
    loss and rows first, then gradient and curvature for each of the round's ``size`` leaves."""
    t = len(values)

    def sums(y, at, n):
        f = np.full(len(y), start)
        for k, v in enumerate(values):
            f += rate * v[at[:, k]]
        p = 1 / (1 + np.exp(-f))
        loss = n * np.logaddexp(0, np.where(y > 0.5, -f, f))
        return np.array([[loss.sum(), *np.bincount(at[:, t], n * (y - p), size)], [n.sum(), *np.bincount(at[:, t], n * p * (1 - p), size)]])
    return sums


def _in_tasks(routed: DataFrame, sums) -> np.ndarray:
    """``sums`` over all rows, each task's added up where its rows are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            y = batch["label"].to_numpy(float)
            got = sums(y, np.frombuffer(b"".join(batch["at"]), np.uint16).reshape(len(y), -1), np.ones(len(y)))
            total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"leaf": np.arange(total.shape[1]), "g": total[0], "h": total[1]})

    got = routed.mapInPandas(run, "leaf int, g double, h double").toPandas()
    return got.groupby("leaf", sort=True)[["g", "h"]].sum().to_numpy().T


def newton_leaves(tables: TreeTables, rows: DataFrame, rate: float, features: str = "features", label: str = "label",
                  most_paths: int = MOST_PATHS) -> tuple[TreeTables, float, list[float]]:
    """Trees with steps for the log loss at their leaves, the margin to start from (log odds), and
    the mean loss before each round.

    ``rows``: 0/1 labels and feature vectors. A leaf that no row reaches has no step. Rows with one
    label and the same leaves in all rounds are one path. ``most_paths`` of them or fewer are summed
    up on the driver, more by one job a round that returns two numbers for each leaf and task.
    """
    leaf = np.flatnonzero(tables.feature < 0)
    tree = tables.tree_of[leaf]
    ids = [leaf[tree == t] for t in range(len(tables.roots))]
    local = np.zeros(len(tables.feature), np.uint16)
    for own in ids:
        local[own] = np.arange(len(own))
    down = tables.router()

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at = local[down(np.stack(batch["x"].to_numpy()))]
                yield pd.DataFrame({"label": batch["label"], "at": [r.tobytes() for r in at]})

    plain = rows.select(F.col(label).cast("double").alias("label"), vector_to_array(F.col(features)).alias("x"))
    # a row's leaves take two bytes a round: kept, so that features are read once
    routed = plain.mapInPandas(route, "label double, at binary").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        paths = routed.groupBy("label", "at").agg(F.count(F.lit(1)).alias("n")).limit(most_paths + 1).toPandas()
        share = routed.agg(F.avg("label")).first()[0]
        start = float(np.log(share / (1 - share)))
        few = len(paths) <= most_paths
        if few:
            y, n = paths["label"].to_numpy(float), paths["n"].to_numpy(float)
            at = np.frombuffer(b"".join(paths["at"]), np.uint16).reshape(len(y), -1)
        values, losses = [], []
        for own in ids:
            sums = _round_sums(start, rate, values, len(own))
            (loss, *g), (count, *h) = sums(y, at, n) if few else _in_tasks(routed, sums)
            losses.append(float(loss / count))
            values.append(np.divide(g, h, out=np.zeros(len(own)), where=np.array(h) > 1e-150))
    finally:
        routed.unpersist()
    value = np.zeros(len(tables.feature))
    for own, v in zip(ids, values):
        value[own] = v
    return replace(tables, value=value), start, losses
