"""Requests that are scored once though they come more than once.

``first_requests`` keeps a request's first row: the state store holds the ids of the last
``delay`` of event time. A row that is older than that has been answered or is too late, and
goes; an id that comes back later than ``delay`` after its first row is a new request.

``BatchFolders`` writes each micro-batch to a folder named by its number. A micro-batch
that is run again, after a crash between writing and committing, replaces its own folder,
so every row is written once however often the sink runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from .scoring import REQUEST_SCHEMA

TIMED_SCHEMA = f"{REQUEST_SCHEMA}, received_at timestamp"


def timed(requests: DataFrame, received_at: Column) -> DataFrame:
    return requests.withColumn("received_at", received_at.cast("timestamp"))


def first_requests(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row for each request id; rows without an id or a time are left out, as nothing could tell them apart."""
    known = stream.where("request_id is not null and received_at is not null")
    return known.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["request_id"])


@dataclass(frozen=True)
class BatchFolders:
    """A sink that can be repeated: a folder for each micro-batch below ``path``."""

    path: str

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def table(self, spark: SparkSession, schema) -> DataFrame:
        """What is written; ``schema`` without the batch's number."""
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self.path)


@dataclass(frozen=True)
class OnceStream:
    """Requests from ``source``, each scored once by ``score``; ``advance`` goes on from the checkpoint."""

    source: str
    sink: BatchFolders
    checkpoint: str
    score: Callable[[DataFrame], DataFrame]
    delay: str = "1 day"

    @staticmethod
    def create(spark: SparkSession, source: str, score: Callable[[DataFrame], DataFrame], delay: str = "1 day") -> OnceStream:
        return OnceStream(source, BatchFolders(shared_path(spark, "once-out")), shared_path(spark, "once-ckpt"), score, delay)

    def _scored(self, spark: SparkSession) -> DataFrame:
        return self.score(first_requests(spark.readStream.schema(TIMED_SCHEMA).parquet(self.source), self.delay))

    def advance(self, spark: SparkSession) -> None:
        query = (self._scored(spark).writeStream.foreachBatch(self.sink).option("checkpointLocation", self.checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()

    def table(self, spark: SparkSession) -> DataFrame:
        return self.sink.table(spark, self._scored(spark).schema)


def deliver(requests: DataFrame, folder: str) -> None:
    """Append timed requests as files of one delivery."""
    requests.select(*[f.split()[0] for f in TIMED_SCHEMA.split(", ")]).write.mode("append").parquet(folder)


def received(request_id: Column) -> Column:
    """A time for a request of the test tables: a second for each id after a fixed day."""
    return F.timestamp_seconds(F.lit(1_700_000_000) + F.abs(request_id))
