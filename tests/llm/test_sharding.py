"""Shards against plain longest-first scheduling, and the laws of the result."""
import random
import zlib
from collections import defaultdict

import pytest

from penalytics.llm import sharding as X


def check(rows, found, shards):
    assert sorted(map(str, (i for i, _ in rows))) == sorted(str(r.doc_id) for r in found)
    slots, loads = defaultdict(list), [0] * shards
    for r in found:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def test_equals_plain_scheduling(docs_of):
    rng = random.Random(4)
    rows = [(i, rng.choice("abcdef") * rng.randrange(1, 400)) for i in range(500)]
    found = X.assign(docs_of(rows).repartition(4), shards=7).collect()
    loads = check(rows, found, 7)
    groups = defaultdict(int)
    for _, t in rows:
        groups[t] += len(t) + 16
    plain = [0] * 7
    for size in sorted(groups.values(), reverse=True):
        plain[plain.index(min(plain))] += size
    assert sorted(loads) == sorted(plain)
    text = dict(rows)
    where = defaultdict(set)
    for r in found:
        where[text[r.doc_id]].add(r.shard)
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    assert all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize("heads", [1, 50])
def test_bundles_keep_groups_whole_and_shards_even(docs_of, heads):
    rng = random.Random(9)
    rows = [(i, f"{rng.randrange(1500)}" * 30) for i in range(3000)]
    found = X.assign(docs_of(rows), shards=4, heads=heads * 40, cell_rows=100).collect()
    loads = check(rows, found, 4)
    assert max(loads) - min(loads) <= 0.05 * max(loads) if heads > 1 else True
    text, where = dict(rows), defaultdict(set)
    for r in found:
        where[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_nulls_and_repeated_rows(docs_of):
    rows = [(1, None), (1, None), (None, ""), (2, "a"), (2, "a"), (None, None), (3, "é" * 100_000)]
    found = X.assign(docs_of(rows), shards=3).collect()
    check(rows, found, 3)
    assert sorted(r.size for r in found) == [16, 16, 16, 16, 17, 17, 200_016]
    assert len({r.shard for r in found if r.size == 16}) == 1


def test_heap():
    items = [(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")]
    assert X.longest_first(items, 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
