"""Distributed order statistics equal plain windows, numpy, DuckDB and brute force."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penalytics.operators import metrics as M
from penalytics.operators.ordered import exact_quantiles, order_code, rank_within, running_sum


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 40, 500).astype(float)
    b = rng.normal(size=500)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "id long, a double, b double"), a, b


def test_quantiles_match_numpy(values):
    df, a, b = values
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column_name"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["a", "b"], probs).collect()}
    for name, arr in (("a", a), ("b", b)):
        for p in probs:
            assert got[(name, p)] == pytest.approx(np.quantile(arr, p), rel=1e-12)


def test_order_code_never_decreases(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=3000) * 10.0 ** rng.integers(-300, 300, 3000), rng.integers(-5, 5, 200).astype(float),
                        [0.0, -0.0, np.inf, -np.inf, 5e-324, 1.7976931348623157e308],
                        *[[2.0 ** k, np.nextafter(2.0 ** k, 0), np.nextafter(2.0 ** k, np.inf)] for k in range(-60, 60)]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    rows = sorted((r["x"], r["c"]) for r in df.select("x", order_code(F.col("x"), T.DoubleType()).alias("c")).collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    words = ["", "a", "ab", "abcd", "abcde", "b", "é", "z", "日本", "\x01"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = {r["s"]: r["c"] for r in df.select("s", order_code(F.col("s"), T.StringType()).alias("c")).collect()}
    ordered = sorted(words, key=lambda w: w.encode())
    assert all(got[a] <= got[b] for a, b in zip(ordered, ordered[1:]))


@pytest.mark.parametrize("hot", [False, True])
def test_rank_within_equals_a_plain_window(spark, values, hot):
    df, _, _ = values
    group = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise((F.lit(0) if hot else F.col("id") % 3).cast("int"))
    g = df.withColumn("g", group).withColumn("s", F.concat(F.lit("k"), F.col("id").cast("string")))
    g = g.withColumn("h", F.xxhash64("id"))
    for order, uniform in ((["a", "id"], False), (["s"], False), (["h", "id"], True), (["b"], False)):
        plain = g.select("id", (F.row_number().over(Window.partitionBy("g").orderBy(*order)) - 1).alias("rank"))
        want = {r["id"]: r["rank"] for r in plain.collect()}
        got = {r["id"]: r["rank"] for r in rank_within(g, ["g"], order, uniform=uniform).collect()}
        assert got == want, order
    assert rank_within(g.limit(0), ["g"], ["b"]).count() == 0


def test_running_sum_without_groups_and_over_many_codes(spark, values):
    df, _, _ = values
    x = df.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    sums = [r["cum_c"] for r in running_sum(x, [], ["a"], ["c"]).orderBy("a").collect()]
    counts = [r["c"] for r in x.orderBy("a").collect()]
    assert sums == list(np.cumsum(counts)) and sums[-1] == 500
    wide = spark.range(20_000).select(((F.col("id") - 9_000) * 3.7).alias("v"), F.lit(2).alias("w"))
    got = running_sum(wide, [], ["v"], ["w"]).orderBy("v").select("cum_w").collect()
    assert [r[0] for r in got] == list(range(2, 40_001, 2))


def test_the_plan_does_not_grow_and_runs_nothing(spark):
    def plan(n):
        df = spark.range(n).select(F.col("id").cast("double").alias("x"))
        return exact_quantiles(df, ["x"], [0.5])._jdf.queryExecution().analyzed().toString()

    assert len(plan(10)) == pytest.approx(len(plan(10**12)), rel=0.02)


def _auc_brute(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y == 1]
    neg = [s for y, s in zip(labels, scores) if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_auc_brute_force_and_monotone_invariance(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300) * 0.5 + 0.4 * y, 2)  # many ties
    rows = [("m", int(a), 0, float(b)) for a, b in zip(y, s)]
    df = spark.createDataFrame(rows, "model string, label int, prediction int, probability double")
    auc = M.roc_auc(df, ["model"]).first()["roc_auc"]
    assert auc == pytest.approx(_auc_brute(y, s), abs=1e-12)
    df2 = df.withColumn("probability", F.exp(F.col("probability") * 3))
    assert M.roc_auc(df2, ["model"]).first()["roc_auc"] == pytest.approx(auc, abs=1e-12)
    single = df.where(F.col("label") == 1)
    assert M.roc_auc(single, ["model"]).first()["roc_auc"] is None


def test_confusion_cells_sum_to_n(spark):
    rows = [("m", i % 2, (i // 2) % 2, 0.1) for i in range(37)]
    df = spark.createDataFrame(rows, "model string, label int, prediction int, probability double")
    assert sum(r["n"] for r in M.confusion_matrix(df, ["model"]).collect()) == 37


def test_quantiles_match_duckdb_on_lineitem(spark):
    import duckdb

    path = "/root/testdata/sf0.01/lineitem.parquet"
    df = spark.read.parquet(path).select("l_extendedprice", "l_quantity")
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = {(r[0], r[1]): r[2] for r in exact_quantiles(df, ["l_extendedprice", "l_quantity"], probs).collect()}
    con = duckdb.connect()
    for c in ("l_extendedprice", "l_quantity"):
        for p in probs:
            want = con.execute(f"SELECT quantile_cont({c}, {p}) FROM read_parquet('{path}')").fetchone()[0]
            assert got[(c, p)] == pytest.approx(want, rel=1e-12), (c, p)


# ---------------------------------------------------------------- over-full codes

def _plain_ranks(df, group, order):
    return {r["id"]: r["rank"] for r in df.select(
        "id", (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).alias("rank")).collect()}


CLOSE = {
    "scores near one": "0.9999D + id * 1e-12D",
    "times in seconds": "1.7e9D + id * 1e-4D",
    "below zero": "-(0.9999D + id * 1e-12D)",
    "a common prefix": "concat('hospital-', lpad(cast(id as string), 7, '0'))",
    "prefixes of each other": "rpad('', cast(id as int) % 40, 'ab')",
    "a small hash range": "id * 1000",
}


@pytest.mark.parametrize("name", list(CLOSE))
def test_over_full_codes_are_split_until_buckets_are_bounded(spark, name):
    from penalytics.operators.ordered import _buckets
    df = spark.range(6000).select("id", (F.col("id") % 2).alias("g"), F.expr(CLOSE[name]).alias("x"))
    uniform = name == "a small hash range"
    bound = 200
    assert df.select(order_code(F.col("x"), df.schema["x"].dataType, uniform).alias("c")).distinct().count() < 40
    placed, leaves, codes = _buckets(df.withColumn("w", F.lit(1)), ["g"], "x", ["w"], uniform, bound)
    largest = placed.groupBy("g", *codes).count().agg(F.max("count")).first()[0]
    assert largest <= bound
    assert placed.select("g", *codes).distinct().count() == leaves.count()
    got = {r["id"]: r["rank"] for r in rank_within(df, ["g"], ["x", "id"], uniform=uniform, bucket_rows=bound).collect()}
    assert got == _plain_ranks(df, "g", ["x", "id"])


def test_ten_million_values_in_one_code(spark):
    """The bound of production: every bucket of 10 million close scores holds at most 2^20."""
    from penalytics.operators.ordered import BUCKET_ROWS, _buckets
    df = spark.range(10_000_000).select(F.lit(0).alias("g"), (F.lit(0.99990001) + F.col("id") * 1e-16 * 1.2).alias("x"), F.lit(1).alias("w"))
    code = order_code(F.col("x"), T.DoubleType())
    assert df.agg(F.max(code) - F.min(code)).first()[0] == 0
    placed, _, codes = _buckets(df, ["g"], "x", ["w"], False, BUCKET_ROWS)
    assert placed.groupBy("g", *codes).count().agg(F.max("count")).first()[0] <= BUCKET_ROWS


def test_ordered_bits_are_those_of_the_double(spark):
    from penalytics.operators.ordered import ordered_bits
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=2000) * 10.0 ** rng.integers(-300, 300, 2000), [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308,
                        1.7976931348623157e308, np.inf, -np.inf, 2.2250738585072009e-308],
                        *[[2.0 ** k, np.nextafter(2.0 ** k, 0), np.nextafter(2.0 ** k, np.inf)] for k in range(-1074, 1024)]])
    want = np.abs(x).view(np.int64) * np.where(x < 0, -1, 1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")
    got = {r["i"]: r["b"] for r in df.select("i", ordered_bits(F.col("x")).alias("b")).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_quantiles_of_close_values(spark):
    rng = np.random.default_rng(4)
    cols = {"a": 0.9999 + rng.integers(0, 3000, 4000) * 2.0 ** -52, "b": np.where(rng.random(4000) < 0.5, -0.0, 0.0),
            "c": -1e-310 * rng.integers(0, 9, 4000), "d": rng.normal(size=4000)}
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in cols.values()])), "a double, b double, c double, d double")
    probs = [0.0, 0.013, 0.5, 0.77, 1.0]
    got = {(r["column_name"], r["prob"]): r["quantile"] for r in exact_quantiles(df, list(cols), probs).collect()}
    for c, v in cols.items():
        for p in probs:
            assert got[c, p] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-320), (c, p)


def test_quantiles_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([(None, 2.5), (None, None)], "a double, b double")
    assert [tuple(r) for r in exact_quantiles(df, ["a", "b"], [0.5]).collect()] == [("b", 0.5, 2.5)]
