"""literal coercion cases."""
import math

from pyspark.sql import functions as F

from penalytics.functions.coerce import na_token_to_null, to_number

CASES = [
    ("", None), ("N/A", None), ("NA", None), ("null", None), ("NaN", None), (" 1.5 ", 1.5),
    ("1.5d", None), ("1e3", 1000.0), ("1,234", None), ("inf", math.inf), ("-Infinity", -math.inf),
    ("Too Few to Report", None), ("+.5", 0.5), ("-2", -2.0), ("7.", 7.0), (None, None),
]


def test_to_number(spark):
    df = spark.createDataFrame([(s,) for s, _ in CASES], "s string")
    got = [r[0] for r in df.select(to_number(F.col("s"))).collect()]
    for (s, want), g in zip(CASES, got):
        assert (g is None and want is None) or g == want, (s, g, want)


def test_numeric_input_nan_becomes_null(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame([(float("nan"),), (2.0,), (None,)], "x double")
    got = [r[0] for r in df.select(to_number(F.col("x"), T.DoubleType())).collect()]
    assert got == [None, 2.0, None]


def test_na_tokens(spark):
    df = spark.createDataFrame([("N/A",), (" NULL ",), ("x",)], "s string")
    assert [r[0] for r in df.select(na_token_to_null(F.col("s"))).collect()] == [None, None, "x"]


def test_to_number_matches_python_float(spark):
    from hypothesis import given, settings, strategies as st

    values = []

    @settings(max_examples=60, deadline=None)
    @given(st.floats(allow_nan=False, allow_infinity=False, width=64))
    def collect(x):
        values.append(x)
    collect()
    texts = [repr(x) for x in values] + [f"{x:.6e}" for x in values]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(to_number(F.col("s"))).collect()]
    assert got == [float(t) for t in texts]
