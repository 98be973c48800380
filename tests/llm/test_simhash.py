"""Fingerprints and components against brute force over all pairs."""
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from penalytics.llm import simhash as X
from penalytics.llm.components import components
from penalytics.sources.tables import table_path


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i: i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    codes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def test_fingerprint():
    rng = random.Random(5)
    for text in ["", " \t\n", "one", "One two", "Ünïcode\x85x\xa0y Ä a b c", *(" ".join(
            rng.choice(["The", "a", "x", "é", "　"]) for _ in range(rng.randrange(1, 60))) for _ in range(100))]:
        assert X.fingerprint(text.encode()) == brute_fingerprint(text)


def test_documents_against_all_pairs(spark, small):
    docs = spark.read.parquet(table_path(small, "documents"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = {i: brute_fingerprint(t) for i, t in rows}
    expected = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    found = X.near_duplicates(docs).select("doc_id", X.fingerprint_hex(F.col("fp")).alias("f"), "component_id").collect()
    assert {r.doc_id: r.f for r in found} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in found} == expected
    left = X.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(expected.values()))


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_join_what_all_pairs_join(spark, distance):
    rng = random.Random(distance)
    values = {0, 1, (1 << 64) - 1}
    while len(values) < 400:
        v = rng.choice(sorted(values)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(1, 5)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    signed = sorted(int(np.uint64(v).astype(np.int64)) for v in values)
    links = X.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance)
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= distance for r in links.collect())
    found = {r.node: r.root for r in components(links).collect()}
    expected = brute_components(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance)
    assert {v: found.get(v, v) for v in signed} == expected


def test_long_chain_and_star(spark):
    links = [(i + 1, i) for i in range(60)] + [(1000 + i, 1000) for i in range(1, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(300)}


def test_nulls_ties_and_repeated_rows(docs_of):
    docs = docs_of([(5, None), (4, ""), (None, " "), (9, "a b c d"), (9, "a b c d"), (8, "A  b\nc d"), (None, "lone words here")])
    found = {(r.doc_id, r.component_id) for r in X.near_duplicates(docs).collect()}
    assert found == {(5, 4), (4, 4), (None, 4), (9, 8), (8, 8), (None, None)}
    assert sorted(str(r.doc_id) for r in X.keep_one(docs).collect()) == ["4", "8", "None"]
    twice = docs_of([(1, "x y z"), (1, "x y z"), (1, "X y z")])
    assert X.keep_one(twice).count() == 1
