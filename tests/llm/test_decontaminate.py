"""Seeds and alignment against a search of every item in every document."""
import random

import numpy as np
import pytest

from penalytics.llm import decontaminate as D
from penalytics.sources.tables import table_path


def plain_alignment(item, window):
    table = [[0] * (len(window) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (D.MATCH if a == b else D.MISMATCH), table[i - 1][j] + D.GAP, table[i][j - 1] + D.GAP)
            best = max(best, table[i][j])
    return best


def test_alignment():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        assert D.smith_waterman(np.array(a), np.array(b))[0] == plain_alignment(a, b)


def brute(docs, items, threshold=D.THRESHOLD):
    found = {}
    for i, t in docs:
        words = D.words_of(t)
        for k, item in items:
            w = D.words_of(item)
            if not w or not words:
                continue
            top = plain_alignment(w, words)
            verbatim = any(" ".join(w[a:a + D.EXCERPT_WORDS]) in " ".join(words) for a in range(len(w) - D.EXCERPT_WORDS + 1))
            if (score := top / (D.MATCH * len(w))) >= threshold or verbatim:
                found[i, k] = score
    return found


@pytest.mark.parametrize("size, share, found", [(300, 0.1, True), (300, 0.25, True), (300, 0.5, True), (300, 0.9, True), (100, 0.25, True),
                                                (100, 0.2, False), (40, 0.5, True), (40, 0.4, False)])
def test_excerpts(spark, docs_of, size, share, found):
    rng = random.Random(size)
    item = [f"w{rng.randrange(400)}" for _ in range(size)]
    at = size // 20
    part = " ".join(item[at: at + int(size * share)])
    rows = [(1, f"before it all {part} and after"), (2, " ".join(sorted(item)[: size // 3])), (3, "x " * 50)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.find_copies(docs_of(rows), bench).collect()] == ([(1, 7)] if found else [])


def test_edited_excerpts_and_sparse_overlaps(spark, docs_of):
    rng = random.Random(3)
    item = [f"w{rng.randrange(500)}" for _ in range(400)]
    part = edited(rng, " ".join(item[100:180]), 0.05)
    sparse = " ".join(w for pair in zip(item[200:320], (f"z{i}" for i in range(120))) for w in pair)  # every other word
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = D.find_copies(docs_of([(1, f"a b {part} c"), (2, sparse)]), bench).collect()
    assert [r.doc_id for r in got] == [1]


@pytest.mark.parametrize("item, text", [
    ("早上去了图书馆", "我们昨天早上去了图书馆然后回家了"), ("ฉันไปห้องสมุดตอนเช้า", "วันนี้ฉันไปห้องสมุดตอนเช้าแล้วกลับบ้าน"),
    ("图书馆", "早上去了图书馆")])
def test_scripts_without_spaces(spark, docs_of, item, text):
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = D.find_copies(docs_of([(1, text), (2, "别的文章没有这些内容")]), bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)]


def test_words():
    for text in ("Ab_1 c-d é", "naïve İ", "x\u0e01y", None, ""):
        assert D.words_of(text) == D.WORDS.findall((text or "").lower())
    assert D.words_of("Ab_1 图书x馆 ünï-cod") == ["ab_1", "图", "书", "x", "馆", "ünï", "cod"]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 5, 6), (2, "no copy here", 7, 8)], "doc_id long, text string, __x_key int, c0 int")
    bench = spark.createDataFrame([(7, "a b c d e")], "item_id long, text string")
    assert [tuple(r) for r in D.keep_clean(docs, bench).collect()] == [(2, "no copy here", 7, 8)]


def edited(rng, text, rate):
    out = []
    for word in text.split():
        u = rng.random()
        out += [f"new{rng.randrange(99)}"] if u < rate / 2 else [] if u < 0.75 * rate else [word, "more"] if u < rate else [word]
    return " ".join(out)


def test_planted_copies(spark, small, docs_of):
    rng = random.Random(6)
    items = [(r.item_id, r.text) for r in spark.read.parquet(table_path(small, "benchmark")).collect()]
    clean = [r.text for r in spark.read.parquet(table_path(small, "documents")).limit(25).collect()]
    rows = [(i, t[:1500]) for i, t in enumerate(clean)]
    for k, item in items:
        base = rng.choice(clean)[:800].split()
        rows.append((1000 + k, " ".join([*base[:40], edited(rng, item, 0.12).upper(), *base[40:]])))
        rows.append((2000 + k, item))
    docs, bench = docs_of(rows), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    found = {(r.doc_id, r.item_id): r.score for r in D.find_copies(docs, bench).collect()}
    expected = brute(rows, items)
    assert all((1000 + k, k) in expected and (2000 + k, k) in expected for k, _ in items)
    assert set(found) == set(expected)
    assert all(found[p] == pytest.approx(expected[p]) for p in found)
    blocks = {(r.doc_id, r.item_id): r.score for r in D.find_copies(docs, bench, block_words=200).collect()}
    assert blocks == found
    left = D.keep_clean(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in found}


def test_every_long_enough_run_holds_a_seed():
    rng = random.Random(2)
    block = D.Block(3)
    block.add(0, " ".join(f"w{rng.randrange(30)}" for _ in range(60)))
    block.index()
    counts = {(3, c): rng.randrange(1000) for c in block.grams[3]}
    places = {at for hits in block.with_seeds(counts, 3).grams[3].values() for _, at in hits}
    assert all(places & set(range(i, i + 3)) for i in range(56))


def test_nulls_ties_and_short_items(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "alpha beta gamma delta"), (3, "one"), (3, "one"), (4, "x " * 50_000 + "alpha beta gamma delta")])
    bench = spark.createDataFrame([(10, "Alpha, beta gamma delta!"), (10, "Alpha, beta gamma delta!"), (11, "one"), (12, None), (13, ""),
                                   (None, "lone words of none")], "item_id long, text string")
    found = sorted(map(str, ((r.doc_id, r.item_id, r.score) for r in D.find_copies(docs, bench).collect())))
    assert found == sorted(["(None, 10, 1.0)", "(3, 11, 1.0)", "(3, 11, 1.0)", "(4, 10, 1.0)"])
    assert sorted(str(r.doc_id) for r in D.keep_clean(docs, bench).collect()) == ["1", "2"]
    assert D.find_copies(docs, bench.limit(0)).count() == 0 and D.keep_clean(docs, bench.limit(0)).count() == 6
