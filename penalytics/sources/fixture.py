"""HRRP-shaped view derived from the TPC-H-like test tables.

One row per hospital x condition, every column a string and dirty on purpose
(see FIXTURES.md, F1).  Mapping: supplier = hospital, part type = condition,
returned line item = readmission.

Plan shape (chosen for scale, not taken from the SQL text):

1. ``lineitem`` joins ``part`` on partkey (broadcast when the part side is below
   the threshold, else sort-merge, where AQE splits a hot part's rows).
2. The joined rows are reduced to (suppkey, condition) counts in the map tasks, so
   that a hot supplier is six rows of a task at most in the shuffle.  Counting by
   (partkey, suppkey) first is left out: that pair is nearly a key of ``lineitem``,
   so all rows would be shuffled once more.
3. The supplier columns are joined to these counts.
4. National rates per condition are re-aggregated from step 3 instead of
   scanning lineitem a second time.  That table has one row per condition (six
   names at most), so it is broadcast and the hospital table isn't shuffled on
   a key of six values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values of the fixture (FIXTURES.md F1): two-letter state codes indexed by
# nation key, and the part-type -> condition names.
STATE_CODES = "ALAKAZARCACOCTDEFLGAHIIDILINIAKSKYLAMEMDMAMIMNMSMO"
PART_TYPE_CONDITION = [
    ("ECONOMY", "Acute Myocardial Infarction (AMI)"),
    ("LARGE", "Heart Failure (HF)"),
    ("MEDIUM", "Pneumonia (PN)"),
    ("PROMO", "COPD"),
    ("SMALL", "Hip/Knee Arthroplasty"),
]
OTHER_CONDITION = "CABG"

RAW_COLUMNS = [
    "facility_id", "facility_name", "state", "measure_name", "number_of_discharges",
    "footnote", "excess_readmission_ratio", "predicted_readmission_rate",
    "expected_readmission_rate", "number_of_readmissions", "start_date", "end_date",
]


def condition_of(pt: Column) -> Column:
    expr = None
    for ptype, name in PART_TYPE_CONDITION:
        expr = (F.when(pt == ptype, name) if expr is None else expr.when(pt == ptype, name))
    return expr.otherwise(OTHER_CONDITION)


def _by_mod7(sk: Column, c0: Column, c1: Column, c2: Column, other: Column) -> Column:
    m = sk % 7
    return F.when(m == 0, c0).when(m == 1, c1).when(m == 2, c2).otherwise(other)


def facility_condition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sk, fname, nk, cond, d, rd): discharges and readmissions per hospital x condition.

    Part types are mapped to conditions before grouping, so all unknown types
    are one condition and (hospital, condition) stays a key.
    """
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_returnflag")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_type").select("p_partkey", condition_of(F.col("p_type")).alias("cond"))
    supp = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")

    per_supp_type = (li.join(part, li.l_partkey == part.p_partkey)
                     .groupBy(F.col("l_suppkey").alias("sk"), "cond")
                     .agg(F.sum(F.lit(1)).alias("d"),
                          F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("rd")))
    return (per_supp_type.join(supp, per_supp_type.sk == supp.s_suppkey)
            .select("sk", F.col("s_name").alias("fname"), F.col("s_nationkey").alias("nk"),
                    "cond", "d", "rd"))


def hrrp_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the dirty all-string hospital x condition table."""
    f = facility_condition_counts(spark, sf_dir)
    nat = f.groupBy("cond").agg(F.sum("rd").alias("nr"), F.sum("d").alias("nd"))
    # one row per condition; the size is fixed by the mapping (six names)
    g = f.join(F.broadcast(nat), "cond")

    sk, d, rd = F.col("sk"), F.col("d"), F.col("rd")
    pred = F.lit(50.0) * rd / d
    expd = F.lit(50.0) * F.col("nr") / F.col("nd")
    vol = _by_mod7(sk, F.floor(2 * d / F.lit(16.0)), 16 * d, F.floor(2 * d / F.lit(4.0)), 2 * d)
    readm = _by_mod7(sk, F.floor(rd / F.lit(16.0)), 8 * rd, F.floor(rd / F.lit(4.0)), rd)
    suppressed = (sk * 7 + rd) % 17 == 0

    def dec4(x: Column) -> Column:
        return x.cast("decimal(10,4)").cast("string")

    na = F.lit("N/A")
    # spellings of a missing value and of a number, by key
    na_any = F.when(sk % 3 == 0, "NA").when(sk % 3 == 1, "null").otherwise(na)
    return g.select(
        F.lpad(sk.cast("string"), F.greatest(F.lit(6), F.length(sk.cast("string"))), F.lit("0")).alias("facility_id"),
        F.col("fname").alias("facility_name"),
        F.lit(STATE_CODES).substr((F.col("nk") * 2 + 1).cast("int"), F.lit(2)).alias("state"),
        F.col("cond").alias("measure_name"),
        F.when(d % 13 == 0, na_any).when(d % 11 == 0, F.concat(vol.cast("bigint").cast("string"), F.lit(".0")))
         .otherwise(vol.cast("bigint").cast("string")).alias("number_of_discharges"),
        F.when(suppressed, F.lit("5")).when((sk * 5 + rd) % 7 == 0, F.lit("29"))
         .otherwise(F.lit(None).cast("string")).alias("footnote"),
        F.when(suppressed, na).otherwise(dec4(F.try_divide(pred, expd))).alias("excess_readmission_ratio"),
        F.when(suppressed, na).otherwise(dec4(pred)).alias("predicted_readmission_rate"),
        F.when(suppressed, na).otherwise(dec4(expd)).alias("expected_readmission_rate"),
        F.when((sk * 3 + rd) % 19 == 0, F.lit("Too Few to Report"))
         .when((sk + rd) % 11 == 0, na_any)
         .when((sk + rd) % 13 == 0, F.concat(readm.cast("bigint").cast("string"), F.lit("e0")))
         .otherwise(readm.cast("bigint").cast("string")).alias("number_of_readmissions"),
        F.lit("07/01/2020").alias("start_date"),
        F.lit("06/30/2023").alias("end_date"),
    )
