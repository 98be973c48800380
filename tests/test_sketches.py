"""Stored sketches against exact counts, and merges against one pass."""
import pytest
from pyspark.sql import functions as F

from penalytics.operators import sketches as S


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(200_000).select(
        (F.col("id") % 5).cast("string").alias("g"), (F.col("id") % 3).alias("h"), (F.col("id") * 7 % 60_000).alias("many"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("v"), F.col("id") % 11)).alias("few"))


def test_error_bound_and_small_counts(rows):
    got = S.estimates(S.distinct_sketches(rows, ["g", "h"], ["many", "few"])).collect()
    exact = {(r.g, r.h): r for r in rows.groupBy("g", "h").agg(F.count_distinct("many").alias("many"), F.count_distinct("few").alias("few"),
                                                              F.count("few").alias("n")).collect()}
    assert len(got) == 30
    for r in got:
        want = exact[r.g, r.h]
        if r.column_name == "few":
            assert (r.n_distinct, r.n_rows) == (want.few, want.n)
        else:  # five standard errors
            assert abs(r.n_distinct - want.many) <= 5 * 0.83 / 2 ** (S.LG_K / 2) * want.many


def test_merging_in_steps_equals_one_merge_and_any_partitioning(rows):
    sketches = S.distinct_sketches(rows, ["g", "h"], ["many", "few"])
    at_once = {r.column_name: (r.n_rows, r.n_distinct) for r in S.estimates(S.merge(sketches, [])).collect()}
    in_steps = {r.column_name: (r.n_rows, r.n_distinct) for r in S.estimates(S.merge(S.merge(sketches, ["g"]), [])).collect()}
    one_pass = S.distinct_sketches(rows.repartition(13, "many"), [], ["many", "few"])
    assert at_once == in_steps == {r.column_name: (r.n_rows, r.n_distinct) for r in S.estimates(S.merge(one_pass, [])).collect()}
    assert abs(at_once["many"][1] - 60_000) <= 0.03 * 60_000 and at_once["few"][1] == 11


def test_overlapping_groups_are_not_added_up(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("b", 2, None), (None, 1, "y")], "g string, h int, v string")
    got = {(r.level, r.g, r.h): (r.n_rows, r.n_distinct) for r in S.roll_up(
        S.distinct_sketches(df, ["g", "h"], ["v"]), [["g", "h"], ["g"], []], ["g", "h"]).collect()}
    assert got[("", None, None)] == (3, 2) and got[("g", "b", None)] == (1, 1) and got[("g", None, None)] == (1, 1)
    assert got[("g,h", "b", 2)] == (0, 0)


def test_clashing_and_empty(spark):
    df = spark.createDataFrame([("a", "b", "c")], "column_name string, n_rows string, _value string")
    got = S.estimates(S.distinct_sketches(df.withColumnRenamed("column_name", "g"), ["g"], ["n_rows", "_value"])).collect()
    assert {(r.g, r.column_name, r.n_distinct) for r in got} == {("a", "n_rows", 1), ("a", "_value", 1)}
    assert S.distinct_sketches(df.limit(0).withColumnRenamed("column_name", "g"), ["g"], ["n_rows"]).count() == 0
