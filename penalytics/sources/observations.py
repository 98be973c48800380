"""Penalty observations with two times, derived from the test tables (FIXTURES F7).

Every line item is an admission at its supplier's hospital for its part's condition. It
carries the penalty label of that hospital and condition, happened at the ship date and
was reported some days later, by key arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import LABEL, MEASURE, STATE
from .fixture import condition_of
from .tables import read_table


def observations(spark: SparkSession, sf_dir: str, cleaned: DataFrame) -> DataFrame:
    """``streaming.windowed.OBSERVATION_SCHEMA`` rows; ``cleaned``: the view with labels (F2)."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_type").select("p_partkey", condition_of(F.col("p_type")).alias("cond"))
    label = cleaned.select(F.col("facility_id").cast("bigint").alias("sk"), F.col(MEASURE).alias("of"), STATE, LABEL)
    placed = li.join(part, li.l_partkey == part.p_partkey)
    placed = placed.join(label, (F.col("l_suppkey") == F.col("sk")) & (F.col("cond") == F.col("of")))
    days = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 45
    at = F.col("l_shipdate").cast("timestamp")
    return placed.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("observation_id"), at.alias("event_time"),
                         (at + F.make_dt_interval(days.cast("int"))).alias("reported_at"), F.col(STATE).alias("state"),
                         F.col(LABEL).cast("int").alias("is_penalized"))
