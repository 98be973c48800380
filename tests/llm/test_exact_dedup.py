"""Grace hashing against a dictionary; tiny tables force spilling to any depth."""
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from penalytics.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]),
                   hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def shown(found):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found)


ROWS = [(1, "a"), (2, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (None, None), (5, "x" * 50_000), (6, "x" * 50_000),
        (7, "only"), (None, "lone")]


@pytest.mark.parametrize("limit", [1, 500, 64 << 20])
def test_nulls_ties_and_long_texts(docs_of, limit):
    docs = docs_of(ROWS).repartition(3)
    found = X.members(docs, table_bytes=limit).collect()
    assert shown(found) == brute(ROWS)
    kept = [r for r in found if r.kept]
    assert len(kept) == 5 and all(r.doc_id == r.keep_id for r in kept)
    left = X.deduplicate(docs, table_bytes=limit)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in kept)


@pytest.mark.parametrize("limit", [2000, 64 << 20])
def test_random_with_a_hot_text(docs_of, limit):
    rng = random.Random(1)
    rows = [(i, "hot" * 30 if i % 3 == 0 else f"t{rng.randrange(200)}" * rng.randrange(1, 5)) for i in range(900)]
    assert shown(X.members(docs_of(rows).repartition(7), table_bytes=limit).collect()) == brute(rows)


def test_contents_are_compared_not_hashes():
    table = X.OpenTable(1 << 20)
    for i in range(3000):
        assert table.find(7, b"%d" % i) < 0
        table.add(7 if i < 50 else i, b"%d" % i)
    assert table.find(7, b"49") == 49 and table.find(2999, b"2999") == 2999 and table.find(7, b"60") < 0


def test_normalised(docs_of):
    found = X.members(docs_of([(1, "A b"), (2, "a  B"), (3, "ab")]),
                      normalise=lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found} == {(1, 2, 2), (2, 2, 2), (3, 3, 1)}
