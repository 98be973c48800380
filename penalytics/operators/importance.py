"""Which columns a fitted model leans on: importance by permutation.

A column is permuted over all rows: each row has a place by one hash of its key and gives
its value by the place of another, so the permuted column is a join of two rankings on the
place. The rankings go through ``ordered``; no task and no driver sees the whole column. The
model scores the rows with that column, and what a metric loses is the column's importance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import metrics as M
from .ordered import rank_within

WHOLE = ""


def places(df: DataFrame, key: list[str], name: str, seed: str) -> DataFrame:
    """``df`` with a place from 0 by a hash of the key; rows that share a key have places next to each other."""
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(seed), *key))
    return rank_within(hashed, [], ["_hash", *key], name, uniform=True).drop("_hash")


def permuted(df: DataFrame, column: str, key: list[str], seed: str = "1", home: DataFrame | None = None) -> DataFrame:
    """``df`` with the values of ``column`` dealt anew over its rows. ``home``: ``df`` with its places, if they are known."""
    home = places(df, key, "_home", "home") if home is None else home
    donors = places(df.select(*dict.fromkeys([*key, column])), key, "_donor", f"{seed}:{column}")
    donors = donors.select("_donor", F.col(column).alias("_dealt"))
    joined = home.join(donors, F.col("_home") == F.col("_donor"))
    return joined.select(*[F.col("_dealt").alias(c) if c == column else F.col(c) for c in df.columns])


def importance(df: DataFrame, columns: list[str], key: list[str], score: Callable[[DataFrame], DataFrame], label: str = M.LABEL,
               seed: str = "1") -> DataFrame:
    """(column_name, accuracy, roc_auc, accuracy_drop, roc_auc_drop): metrics with the column permuted, and
    what they lose against the untouched rows. ``score`` adds prediction and probability."""
    ensure_checkpoint_dir(df.sparkSession)
    # kept in the shared folder: places are those of every column, and the scores are read by both metrics
    home, every = places(df, key, "_home", "home").checkpoint(), None
    for c in [WHOLE, *columns]:
        scored = score(permuted(df, c, key, seed, home) if c else df)
        part = scored.select(F.lit(c).alias(M.MODEL), F.col(label).alias(M.LABEL), M.PRED, M.PROB)
        every = part if every is None else every.unionByName(part)
    every = every.checkpoint()
    accuracy = M.binary_metrics(every, [M.MODEL]).select(M.MODEL, "accuracy")
    found = accuracy.join(M.roc_auc(every, [M.MODEL]), M.MODEL)
    base = found.where(F.col(M.MODEL) == WHOLE).select(F.col("accuracy").alias("_a"), F.col("roc_auc").alias("_r"))
    # a row for each column
    return found.where(F.col(M.MODEL) != WHOLE).select(
        F.col(M.MODEL).alias("column_name"), "accuracy", "roc_auc", (base.select("_a").scalar() - F.col("accuracy")).alias("accuracy_drop"),
        (base.select("_r").scalar() - F.col("roc_auc")).alias("roc_auc_drop"))
