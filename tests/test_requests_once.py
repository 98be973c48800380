"""Repeated requests and repeated micro-batches add no row."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from penalytics.session import shared_path
from penalytics.streaming import once as O

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def requests(spark, ids, at):
    rows = [(i, "AL", "COPD", 100.0, 16.0, 15.0, 20.0, at) for i in ids]
    return spark.createDataFrame(rows, O.TIMED_SCHEMA)


def keep(df):
    return df.select("request_id", "received_at")


def ids(stream, spark):
    return sorted(r.request_id for r in stream.table(spark).collect())


@pytest.fixture()
def stream(spark):
    return O.OnceStream.create(spark, shared_path(spark, "t-requests"), keep, delay="2 days")


def test_a_replayed_file_adds_no_row_also_after_a_restart(spark, stream):
    first = requests(spark, [1, 2, 2, 3], START)
    O.deliver(first, stream.source)
    stream.advance(spark)
    assert ids(stream, spark) == [1, 2, 3]
    O.deliver(first, stream.source)
    O.deliver(requests(spark, [3, 4], START + DAY), stream.source)
    stream.advance(spark)
    assert ids(stream, spark) == [1, 2, 3, 4]
    stream.advance(spark)
    assert ids(stream, spark) == [1, 2, 3, 4]


def test_an_id_is_new_after_the_delay(spark, stream):
    for days in (0, 1, 10, 11):
        O.deliver(requests(spark, [1], START + days * DAY), stream.source)
        O.deliver(requests(spark, [100 + days], START + days * DAY), stream.source)
        stream.advance(spark)
    assert ids(stream, spark) == [1, 1, 100, 101, 110, 111]
    O.deliver(requests(spark, [1, 500], START), stream.source)  # older than the watermark: gone
    stream.advance(spark)
    assert ids(stream, spark) == [1, 1, 100, 101, 110, 111]


def test_a_repeated_micro_batch_replaces_itself(spark):
    sink = O.BatchFolders(shared_path(spark, "t-sink"))
    one, two = spark.range(3), spark.range(3, 5)
    for number, batch in ((0, one), (1, two), (1, two), (0, one), (1, two)):
        sink(batch, number)
    assert sorted(r.id for r in sink.table(spark, "id long").collect()) == [0, 1, 2, 3, 4]


def test_rows_without_id_or_time(spark, stream):
    rows = requests(spark, [1, None], START).unionByName(requests(spark, [2], None))
    O.deliver(rows, stream.source)
    stream.advance(spark)
    assert ids(stream, spark) == [1]
    assert O.timed(spark.range(1), F.lit("2024-01-01")).columns == ["id", "received_at"]
