"""Penalty rate per state over event-time windows of a stream.

Observations arrive as Parquet files: when something happened (``event_time``), when it was
reported (``reported_at``), where, and whether it carries a penalty. A window closes
``lateness`` after its end, and an observation reported later than that is late and left
out. That rule looks at the row alone, so it doesn't depend on how rows are dealt over files
and micro-batches.

The state store holds a count and a sum for each open window and state. The watermark
follows the largest event time by ``lateness`` plus ``disorder``: nothing is reported before it
happened, so when that passes a window's end, every row of it that isn't late has been
reported, and has been read if files come in order of their reports up to ``disorder``. A
window goes out then, once (append mode), and its state is freed. Windows that the watermark
hasn't passed are still open and not part of the output.

The checkpoint and the output lie in the shared folder; a stream that is started again with
the same folders goes on where it stopped, and a micro-batch that is run twice is written
once (the file sink's log).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

OBSERVATION_SCHEMA = "observation_id long, event_time timestamp, reported_at timestamp, state string, is_penalized int"


@dataclass(frozen=True)
class WindowRule:
    """Windows, and when they close. Durations as Spark intervals, in days or smaller fixed units."""

    size: str = "30 days"
    slide: str | None = None
    lateness: str = "10 days"
    disorder: str = "0 days"

    @property
    def delay(self) -> str:
        return f"{self.lateness} {self.disorder}"

    def window(self, time: Column | str = "event_time") -> Column:
        return F.window(time, self.size, self.slide) if self.slide else F.window(time, self.size)


def known(observations: DataFrame) -> DataFrame:
    """Observations with a state and a label, reported when or after they happened. Others
    count nowhere and move no watermark: one wrong clock in the future would close every window."""
    return observations.where("state is not null and is_penalized is not null and event_time <= reported_at")


def in_time(observations: DataFrame, rule: WindowRule) -> DataFrame:
    """A row for each observation and window that it counts in."""
    placed = observations.withColumn("window", rule.window())
    return placed.where(F.col("reported_at") <= F.col("window.end") + F.expr(f"interval {rule.lateness}"))


def rates(observations: DataFrame, rule: WindowRule = WindowRule()) -> DataFrame:
    """(window_start, window_end, state, n_rows, n_penalized, penalty_rate_pct), batch or streaming."""
    placed = in_time(known(observations).withWatermark("event_time", rule.delay), rule)
    sums = placed.groupBy("window", "state").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("is_penalized").cast("long")).alias("n_penalized"))
    return sums.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "state", "n_rows",
                       "n_penalized", (F.lit(100.0) * F.col("n_penalized") / F.col("n_rows")).alias("penalty_rate_pct"))


def closed_rates(observations: DataFrame, rule: WindowRule = WindowRule()) -> DataFrame:
    """The batch counterpart: the windows that are closed once all of ``observations`` are read."""
    seen = known(observations).agg((F.max("event_time") - F.expr(f"interval {rule.delay}")).alias("passed"))
    found = rates(observations, rule)
    return found.where(F.col("window_end") <= seen.scalar())


def deliver(observations: DataFrame, folder: str, lower: Column | None = None, upper: Column | None = None) -> None:
    """Append the observations reported from ``lower`` to before ``upper`` as files of one delivery."""
    part = observations
    if lower is not None:
        part = part.where(F.col("reported_at") >= lower)
    if upper is not None:
        part = part.where(F.col("reported_at") < upper)
    part.write.mode("append").parquet(folder)


def observation_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The files of ``folder`` in the order in which they came; without a number all that are there make a micro-batch."""
    reader = spark.readStream.schema(OBSERVATION_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


@dataclass(frozen=True)
class RateStream:
    """A stream of windowed rates with its folders; ``advance`` reads what has come since."""

    source: str
    out: str
    checkpoint: str
    rule: WindowRule = WindowRule()
    files_per_trigger: int | None = None

    @staticmethod
    def create(spark: SparkSession, source: str, rule: WindowRule = WindowRule(), files_per_trigger: int | None = None) -> RateStream:
        return RateStream(source, shared_path(spark, "rates-out"), shared_path(spark, "rates-ckpt"), rule, files_per_trigger)

    def advance(self, spark: SparkSession) -> int:
        """Process all files there are, then stop. Returns rows that the watermark dropped as
        files were more out of order than ``disorder`` allows (over the last micro-batches that Spark remembers)."""
        stream = rates(observation_stream(spark, self.source, self.files_per_trigger), self.rule)
        query = (stream.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint)
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
        return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("window_start timestamp, window_end timestamp, state string, n_rows long, n_penalized long, "
                                 "penalty_rate_pct double").parquet(self.out)
