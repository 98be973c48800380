"""Comparison of a hospital with its peers.

Peers are the other hospitals with the same condition in the same band of volume. For
each wanted column a row gets the mean of its peers (itself left out) and its percentile
rank among them.

A condition is a hot key: six of them hold all rows. So sums and counts are partial
aggregates that meet as one row per group, and ranks come from counts per distinct value
through ``ordered``; no group is gathered anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import DISCHARGES, MEASURE, PREDICTED, RATIO, READMISSIONS
from .ordered import running_sum

#: Least discharges of each band, largest first; the thresholds of the reference's volume rules.
BANDS = [("large", 1000), ("medium", 100), ("small", 25), ("tiny", None)]
BAND, SHARE = "volume_band", "readmission_share"


def volume_band(discharges: Column) -> Column:
    """Band of a number of discharges; null without one."""
    expr = F.when(discharges.isNull() | F.isnan(discharges), F.lit(None).cast("string"))
    for name, least in BANDS:
        expr = expr.when(discharges >= least, name) if least is not None else expr.otherwise(name)
    return expr


def peer_comparison(df: DataFrame, key: list[str], columns: list[str], groups: list[str], places: int | None = None) -> DataFrame:
    """(key..., groups..., column_name, value, n_peers, peer_mean, gap, percentile) for every non-null value.

    ``percentile``: share of the peers with a smaller value, from 0 to 1. Without peers the
    last three are null. A null group is a group; rows with one key count each. ``places``:
    values are summed up as decimals with so many places, so that a mean doesn't depend on
    the order of the rows (for values below 10^18).
    """
    long = df.select(*key, *groups, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ids=[*key, *groups], values=columns, variableColumnName="column_name", valueColumnName="value")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    within = [*groups, "column_name"]
    exact = F.col("value").cast(f"decimal(28,{places})") if places is not None else F.col("value")
    counts = long.groupBy(*within, "value").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sum(counts, within, ["value"], ["_n"]).select(
        *within, "value", (F.col("cum__n") - F.col("_n")).alias("_below"))
    sums = long.groupBy(*within).agg(F.count(F.lit(1)).alias("_all"), F.sum(exact).alias("_sum"))

    def same(right: DataFrame, on: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(right[f"_r_{c}"]) for c in on])

    def keyed(table: DataFrame, on: list[str]) -> DataFrame:
        return table.withColumnsRenamed({c: f"_r_{c}" for c in on})

    ranks, totals = keyed(placed, [*within, "value"]), keyed(sums, within)
    joined = long.alias("l").join(ranks, same(ranks, [*within, "value"])).select("l.*", "_below")
    joined = joined.alias("l").join(totals, same(totals, within)).select("l.*", "_all", "_sum")
    peers = F.col("_all") - 1
    mean = F.try_divide((F.col("_sum") - exact).cast("double"), peers.cast("double"))
    return joined.select(*key, *within, "value", peers.alias("n_peers"), mean.alias("peer_mean"), (F.col("value") - mean).alias("gap"),
                         F.try_divide(F.col("_below").cast("double"), peers.cast("double")).alias("percentile"))


def hospital_peers(cleaned: DataFrame, key: str = "facility_id") -> DataFrame:
    """J4 on the cleaned table: ratio, predicted rate and share of readmissions among hospitals of a condition and volume."""
    d = F.col(DISCHARGES)
    df = cleaned.select(key, MEASURE, volume_band(d).alias(BAND), RATIO, PREDICTED,
                        F.when(d > 0, F.col(READMISSIONS) / d).alias(SHARE))
    return peer_comparison(df, [key], [RATIO, PREDICTED, SHARE], [MEASURE, BAND], places=10)
