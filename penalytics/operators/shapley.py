"""Why a tree model scores a row as it does: path-dependent Shapley values.

The value of a set of features is what the trees expect of a row when only these are known:
a split on another feature sends the row both ways, by the shares of the fitted rows. A
leaf counts for the features on its path alone. With o (0 or 1) whether the row keeps to all of
a feature's conditions on the path, and z the share of the fitted rows that do, its part for
feature i is value * (o_i - z_i) times a weighted sum of the coefficients of
prod_{j != i} (z_j + o_j t). So each leaf is a few array operations over a batch of rows.

Rows are explained where they are, in Arrow batches; the node tables are as large as the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tree_tables import TreeTables, TreeTablesModel

#: What a leaf's path asks of its features: feature -> (more than, at most, share of rows).
Path = dict[int, tuple[float, float, float]]


def leaf_paths(tables: TreeTables) -> list[tuple[float, Path]]:
    """Value and path of every leaf that fitted rows reach."""
    found = []
    stack: list[tuple[int, Path]] = [(int(r), {}) for r in tables.roots]
    while stack:
        k, path = stack.pop()
        f = int(tables.feature[k])
        if f < 0:
            found.append((float(tables.value[k]), path))
            continue
        cut = float(tables.threshold[k])
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((tables.left[k], (low, min(high, cut))), (tables.right[k], (max(low, cut), high))):
            part = tables.rows[child] / tables.rows[k]
            if part > 0:
                stack.append((int(child), {**path, f: (*bounds, share * part)}))
    return found


def explainer(tables: TreeTables, scale: float = 1.0):
    """A function of feature rows to their values per feature, and the value without any feature."""
    leaves = [(scale * v, np.array(list(p), np.int64), np.array([b[0] for b in p.values()]), np.array([b[1] for b in p.values()]),
               np.array([b[2] for b in p.values()])) for v, p in leaf_paths(tables)]
    base = float(sum(v * z.prod() for v, _, _, _, z in leaves))
    most = max((len(z) for *_, z in leaves), default=0)
    weights = {m: np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]) for m in range(1, most + 1)}

    def explain(x):
        out = np.zeros_like(x, dtype=float)
        for value, features, low, high, z in leaves:
            m = len(features)
            if not m or not value:
                continue
            own = x[:, features]
            o = ((own > low) & (own <= high)).astype(float)
            for i in range(m):
                poly = np.zeros((len(x), m))
                poly[:, 0] = 1.0
                for step, j in enumerate([j for j in range(m) if j != i], 1):
                    poly[:, 1:step + 1] = z[j] * poly[:, 1:step + 1] + o[:, [j]] * poly[:, :step]
                    poly[:, 0] *= z[j]
                out[:, features[i]] += value * (o[:, i] - z[i]) * (poly @ weights[m])
        return out

    return explain, base


def feature_sources(prepared: DataFrame, columns: list[str], features: str = "features") -> list[str]:
    """The source column of each entry of the feature vector, by the names that the assembler left."""
    attributes = prepared.schema[features].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attributes.values() for a in kind}
    longest_first = sorted(columns, key=len, reverse=True)
    return [next(c for c in longest_first if names[i].startswith(f"{c}_")) for i in sorted(names)]


def explain_rows(model: PipelineModel, df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key..., column_name, contribution, base_value, model_value): a row for each row and source column.

    ``model_value`` is the share of class 1 of trees, or the margin of boosted ones; it is the base value
    plus the contributions. Entries that come from one column, such as its levels, are added up.
    """
    *before, last = model.stages
    if not isinstance(last, TreeTablesModel):
        raise TypeError("only models with node tables can be explained")
    tables, steps = last.table(), last.getOrDefault(last.kind) == "steps"
    scale = last.getOrDefault(last.rate) if steps else 1.0 / len(tables.roots)
    start = last.getOrDefault(last.start) if steps else 0.0
    prepared = PipelineModel(before).transform(df)
    sources = feature_sources(prepared, columns)
    place = np.array([columns.index(c) for c in sources])
    explain, base = explainer(tables, scale)
    base, n, names = base + start, len(columns), list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            each = explain(np.stack(batch["_x"].to_numpy()))
            sums = np.zeros((len(batch), n))
            np.add.at(sums.T, place, each.T)
            out = batch[key].loc[batch.index.repeat(n)].reset_index(drop=True)
            out["column_name"] = names * len(batch)
            out["contribution"] = sums.ravel()
            out["base_value"] = base
            out["model_value"] = np.repeat(base + sums.sum(axis=1), n)
            yield out

    schema = T.StructType([*[df.schema[c] for c in key], T.StructField("column_name", T.StringType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("contribution", "base_value", "model_value")]])
    return prepared.select(*key, vector_to_array("features").alias("_x")).mapInPandas(run, schema)
