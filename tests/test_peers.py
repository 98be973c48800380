"""Peer comparison against plain loops."""
import random

import pytest
from pyspark.sql import functions as F

from penalytics.operators import peers as P

SCHEMA = "k long, g string, h string, a double, b double"


def plain(rows):
    out = {}
    for c in (3, 4):
        for i, r in enumerate(rows):
            if r[c] is None or r[c] != r[c]:
                continue
            others = [q[c] for j, q in enumerate(rows) if j != i and q[1:3] == r[1:3] and q[c] is not None and q[c] == q[c]]
            n = len(others)
            mean = sum(others) / n if n else None
            out[r[0], "ab"[c - 3]] = (n, mean, r[c] - mean if n else None, sum(x < r[c] for x in others) / n if n else None)
    return out


def test_equals_plain_loops(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice(["s", None]), rng.choice([None, float("nan"), 1.0, 2.0, rng.random()]), rng.gauss(0, 1))
            for i in range(200)] + [(900, "alone", "s", 1.0, None)]
    got = P.peer_comparison(spark.createDataFrame(rows, SCHEMA).repartition(3), ["k"], ["a", "b"], ["g", "h"]).collect()
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        n, *rest = want[r.k, r.column_name]
        assert r.n_peers == n
        assert [r.peer_mean, r.gap, r.percentile] == [x if x is None else pytest.approx(x, abs=1e-9) for x in rest]


def test_bands(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (24.9,), (25.0,), (99.0,), (100.0,), (999.0,), (1000.0,)], "d double")
    got = [r.b for r in df.select(P.volume_band(F.col("d")).alias("b")).collect()]
    assert got == [None, None, "tiny", "tiny", "small", "small", "medium", "medium", "large"]


def test_a_hot_group_is_not_gathered(spark):
    """Windows hold counts per code; no window's rows are those of a group."""
    df = spark.range(3000).select("id", F.lit("one").alias("g"), F.col("id").cast("double").alias("a"))
    frame = P.peer_comparison(df, ["id"], ["a"], ["g"])
    got = {r.id: (r.n_peers, r.percentile) for r in frame.collect()}
    assert got[0] == (2999, 0.0) and got[2999] == (2999, 1.0)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window [" in line and "_code" not in line and "_c0" not in line and "_block" not in line]
