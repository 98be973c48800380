"""Sources: CSV loader (S1-S4), dimensions (S5), fixture shape."""
from pyspark.sql import functions as F

from penalytics.plans import catalog as K
from penalytics.session import shared_path
from penalytics.sources import csv_loader as CSV
from penalytics.sources.dimensions import benchmark_dim, state_dim
from tests.conftest import SF_SMALL


def test_missing_csv_returns_none(spark):
    assert CSV.load_hrrp_csv(spark, shared_path(spark, "does-not-exist") + "/x.csv") is None


def test_csv_keeps_leading_zeros_and_nulls_tokens(spark):
    path = CSV.write_csv(K.raw(spark, SF_SMALL), shared_path(spark, "t-csv"))
    df = CSV.load_hrrp_csv(spark, path, persist=True)
    assert df.where(F.length("facility_id") != 6).count() == 0
    assert df.where(F.col("excess_readmission_ratio") == "N/A").count() == 0
    assert df.where(F.col("number_of_readmissions") == "Too Few to Report").count() > 0
    assert df.count() == K.raw(spark, SF_SMALL).count()


def test_published_headers_rename(spark):
    df = spark.createDataFrame([("A", "010001")], "`Facility Name` string, `Facility ID` string")
    assert CSV.rename_published_headers(df).columns == ["facility_name", "facility_id"]


def test_dimensions(spark):
    assert state_dim(spark).count() == 56
    assert benchmark_dim(spark).count() == 6


def test_fixture_grain_is_unique(spark):
    raw = K.raw(spark, SF_SMALL)
    assert raw.count() == raw.select("facility_id", "measure_name").distinct().count() == 60


def test_partitioned_sink_prunes(spark):
    from penalytics.sources.sinks import read_table, write_table
    path = write_table(K.cleaned(spark, SF_SMALL), shared_path(spark, "t-clean"), ["state"],
                       ["facility_id", "measure_name"])
    df = read_table(spark, path)
    q = df.where(F.col("state") == "AL")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(state" in plan and "AL" in plan
    assert q.count() == K.cleaned(spark, SF_SMALL).where(F.col("state") == "AL").count()
    assert df.count() == K.cleaned(spark, SF_SMALL).count()


def _tables(spark, folder, types=("ECONOMY", "LARGE", "NEW1", "NEW2"), keys=(7, 123456, 1234567, 1234568)):
    """A small set of tables: wide supplier keys, unknown part types, a condition without returns."""
    parts = [(i, t) for i, t in enumerate(types)]
    suppliers = [(k, f"S{k}", k % 25) for k in keys]
    lines = [(p, k, "R" if types[p] != "LARGE" and (n + k) % 3 == 0 else "N") for p, _ in parts for k in keys for n in range(9)]
    for name, rows, schema in (("part", parts, "p_partkey long, p_type string"),
                               ("supplier", suppliers, "s_suppkey long, s_name string, s_nationkey long"),
                               ("lineitem", lines, "l_partkey long, l_suppkey long, l_returnflag string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_wide_ids_unknown_types_and_a_condition_without_returns(spark, tmp_path):
    from penalytics.operators import clean as C
    from penalytics.sources.fixture import hrrp_raw
    df = hrrp_raw(spark, _tables(spark, tmp_path))
    rows = df.collect()
    assert {r["facility_id"] for r in rows} == {"000007", "123456", "1234567", "1234568"}
    keys = [(r["facility_id"], r["measure_name"]) for r in rows]
    assert len(keys) == len(set(keys)) == 12  # both unknown types are one condition
    none = [r for r in rows if r["measure_name"] == "Heart Failure (HF)"]
    assert len(none) == 4 and all(r["excess_readmission_ratio"] in (None, "N/A") for r in none)
    assert C.clean(df).where("measure_name = 'Heart Failure (HF)'").count() == 0


def test_strict_drop_keeps_complete_rows_with_a_footnote(spark):
    from penalytics.operators import clean as C
    from penalytics.plans import catalog as K
    from tests.conftest import SF_MID
    kept = C.clean_strict(K.raw(spark, SF_MID)).collect()
    assert len(kept) > 10 and {r["footnote"] for r in kept} == {"29"}


def test_spellings_reach_the_view(spark):
    from penalytics.plans import catalog as K
    from tests.conftest import SF_MID
    texts = [r[0] for r in K.raw(spark, SF_MID).select("number_of_discharges").collect()]
    assert {"N/A", "NA", "null"} <= set(texts) and any(t.endswith(".0") for t in texts)


def test_line_items_are_shuffled_once_at_most_and_joined_as_often_as_keys_repeat(spark, tmp_path):
    from collections import Counter
    from penalytics.sources.fixture import condition_of, facility_condition_counts
    parts = [(1, "LARGE"), (1, "PROMO"), (2, "LARGE"), (3, None), (None, "LARGE")]
    suppliers = [(5, "S5", 0), (6, "S6", 1), (6, "S6b", 2), (None, "none", 3)]
    lines = [(p, k, f) for p in (1, 1, 2, 3, 4, None) for k in (5, 6, 7, None) for f in ("R", "N", None)]
    for name, rows, schema in (("part", parts, "p_partkey long, p_type string"),
                               ("supplier", suppliers, "s_suppkey long, s_name string, s_nationkey long"),
                               ("lineitem", lines, "l_partkey long, l_suppkey long, l_returnflag string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    df = facility_condition_counts(spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.collect())
    names = {r["t"]: r["c"] for r in spark.createDataFrame(parts, "k long, t string").select("t", condition_of(F.col("t")).alias("c")).collect()}
    d, rd = Counter(), Counter()
    for p, k, f in lines:
        for t in (t for q, t in parts if p is not None and q == p):
            d[k, names[t]] += 1
            rd[k, names[t]] += f == "R"
    assert got == sorted((k, s, n, c, d[k, c], rd[k, c]) for k, c in d for q, s, n in suppliers if k is not None and q == k)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange" in x and "l_partkey" in x and "l_suppkey" in x]  # no shuffle by the pair
