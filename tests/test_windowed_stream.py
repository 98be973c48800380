"""Windowed rates: stream and batch agree whatever the order of files, and after restarts."""
import datetime as dt
import random

import pytest

from penalytics.session import shared_path
from penalytics.streaming import windowed as W

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)
RULE = W.WindowRule(size="5 days", lateness="2 days", disorder="6 days")


def made(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + dt.timedelta(minutes=rng.randrange(60 * 24 * 60))
        rows.append((i, at, at + rng.choice([0, 1, 3, 9]) * DAY, rng.choice(["AL", "NY", None]), rng.choice([0, 1, 1, None])))
    rows += [(n, START + 400 * DAY, START, "AL", 1), (n + 1, None, START, "AL", 1), (n + 2, START, None, "AL", 1)]
    return rows


def plain(rows, delay=8):
    """Counts per closed window and state; the watermark's windows begin at multiples of five days."""
    ok = [r for r in rows if r[1] and r[2] and r[3] and r[4] is not None and r[1] <= r[2]]
    passed = max(r[1] for r in ok) - delay * DAY
    out = {}
    for _, at, reported, state, hit in ok:
        begin = dt.datetime(1970, 1, 1) + ((at - dt.datetime(1970, 1, 1)) // (5 * DAY)) * 5 * DAY
        end = begin + 5 * DAY
        if reported <= end + 2 * DAY and end <= passed:
            n, k = out.get((begin, state), (0, 0))
            out[begin, state] = n + 1, k + hit
    return out


def counts(frame):
    got = frame.collect()
    assert all(r.penalty_rate_pct == pytest.approx(100 * r.n_penalized / r.n_rows) for r in got)
    found = {(r.window_start, r.state): (r.n_rows, r.n_penalized) for r in got}
    assert len(found) == len(got)  # each window once
    return found


def deliver(spark, folder, rows):
    W.deliver(spark.createDataFrame(rows, W.OBSERVATION_SCHEMA).coalesce(1), folder)


def test_batch_equals_plain_counting(spark):
    rows = made()
    got = counts(W.closed_rates(spark.createDataFrame(rows, W.OBSERVATION_SCHEMA), RULE))
    assert got == plain(rows) and len(got) > 10


@pytest.mark.parametrize("order", ["by report", "shuffled within the bound"])
def test_stream_equals_batch_in_any_allowed_order_and_after_restarts(spark, order):
    rows = [r for r in made(seed=5) if r[2]]
    rows.sort(key=lambda r: r[2])
    parts = [[r for r in rows if (r[2] - START) // (2 * DAY) == k] for k in range(40)] + [[r for r in rows if (r[2] - START) // (2 * DAY) >= 40]]
    parts = [p for p in parts if p]
    if order != "by report":  # neighbours change places: at most four days out of order
        for k in range(0, len(parts) - 1, 2):
            parts[k], parts[k + 1] = parts[k + 1], parts[k]
    stream = W.RateStream.create(spark, shared_path(spark, "t-observations"), RULE, files_per_trigger=2)
    dropped = 0
    for k, part in enumerate(parts):
        deliver(spark, stream.source, part)
        if k % 9 == 4 or k == len(parts) - 1:  # stopped and started again from its checkpoint
            dropped += stream.advance(spark)
    assert counts(stream.table(spark)) == plain(rows)
    assert dropped == 0


def test_more_disorder_than_allowed_is_counted(spark):
    rule = W.WindowRule(size="5 days", lateness="2 days")
    new = [(1, START + 50 * DAY, START + 50 * DAY, "AL", 1)]
    old = [(2, START, START, "AL", 1), (3, START + 49 * DAY, START + 49 * DAY, "AL", 0)]
    stream = W.RateStream.create(spark, shared_path(spark, "t-observations"), rule)
    dropped = 0
    for part in (new, [(4, START + 51 * DAY, START + 51 * DAY, "AL", 1)], old, [(5, START + 90 * DAY, START + 90 * DAY, "NY", 1)]):
        deliver(spark, stream.source, part)
        dropped += stream.advance(spark)
    assert dropped == 1
    got = counts(stream.table(spark))
    assert sum(n for n, _ in got.values()) == 3


def test_late_reports_count_nowhere(spark):
    end = dt.datetime(1970, 1, 1) + ((START - dt.datetime(1970, 1, 1)) // (5 * DAY) + 1) * 5 * DAY
    rows = [(1, START, end + 2 * DAY, "AL", 1), (2, START, end + 2 * DAY + dt.timedelta(seconds=1), "AL", 1),
            (3, START + 60 * DAY, START + 60 * DAY, "AL", 1)]
    stream = W.RateStream.create(spark, shared_path(spark, "t-observations"), RULE)
    deliver(spark, stream.source, rows)
    stream.advance(spark)
    assert list(counts(stream.table(spark)).values()) == [(1, 1)]


def test_a_second_start_without_new_files_adds_nothing(spark):
    stream = W.RateStream.create(spark, shared_path(spark, "t-observations"), RULE)
    deliver(spark, stream.source, made(seed=8))
    stream.advance(spark)
    before = counts(stream.table(spark))
    stream.advance(spark)
    assert counts(stream.table(spark)) == before and before


def test_sliding_windows_equal_batch(spark):
    rule = W.WindowRule(size="6 days", slide="3 days", lateness="2 days", disorder="60 days")
    rows = made(150, seed=9) + [(999, START + 200 * DAY, START + 200 * DAY, "AL", 1)]
    stream = W.RateStream.create(spark, shared_path(spark, "t-observations"), rule)
    deliver(spark, stream.source, rows)
    stream.advance(spark)
    assert counts(stream.table(spark)) == counts(W.closed_rates(spark.createDataFrame(rows, W.OBSERVATION_SCHEMA), rule))


def test_no_rows(spark):
    stream = W.RateStream.create(spark, shared_path(spark, "t-observations"), RULE)
    deliver(spark, stream.source, [])
    stream.advance(spark)
    assert stream.table(spark).collect() == []
