"""Alignments against plain loops over both libraries' tokens."""
import hashlib
import os
from collections import Counter

import pytest

from penalytics.llm import token_alignment as X
from penalytics.llm.queries import A_FILE, MODEL_FILE

pytestmark = pytest.mark.skipif(not (os.path.exists(A_FILE) and os.path.exists(MODEL_FILE)), reason="needs the tokenizer files")

TEXTS = ["Hello world, it's 12345.", "", None, "naïve café — “quoted” Straße", "早上去了图书馆 and back", "  two  spaces   \n\n\ttabs ",
         "<|endoftext|> </s> <unk> <0x0A>", "a▁b", "🙂🙂 emoji 🏳️‍🌈", "\0 nul", "x" * 300, "Hello world, it's 12345.",
         " ", "\n", "ɐʁ ɛ mixed", "the the the the", "ß" * 50 + " " * 200 + "é"]


@pytest.fixture(scope="module")
def tool():
    return X.Aligner(A_FILE, MODEL_FILE)


def plain(tool, text):
    """ids of both sides, groups as (ids, ids), overlaps: by loops over byte ranges."""
    if not text:
        return [], [], [], []
    a = tool.sides[0].library.encode(" " + text, add_special_tokens=False).ids
    b = tool.sides[1].library.encode(text)
    parts = [[s.pieces[i] for i in x] for s, x in zip(tool.sides, (a, b))]
    if any(b"".join(p) != b" " + text.encode() for p in parts):
        return [], [], [], []
    ends = [[sum(map(len, p[:k + 1])) for k in range(len(p))] for p in parts]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    over = [(i, j) for i in range(len(a)) for j in range(len(b))
            if max(ends[0][i] - len(parts[0][i]), ends[1][j] - len(parts[1][j])) < min(ends[0][i], ends[1][j])]
    return a, b, groups, over


def expected(tool, texts):
    found, holds, links = [], Counter(), []
    for t in texts:
        a, b, groups, _ = plain(tool, t)
        own = Counter((i, j) for x, y in groups for i in x for j in y)
        links.append(own)
        holds.update(own.keys())
        sha = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
        found.append([len(a), len(b), len(groups), sum(own.values()), sha if groups else ""])
    best = {}
    for (i, _), n in holds.items():
        best[i] = max(best.get(i, 0), n)
    for row, own in zip(found, links):
        row.insert(4, sum(k for p, k in own.items() if holds[p] == best[p[0]]))
        row.insert(5, sum(k * holds[p] for p, k in own.items()))
    return found, holds


def as_row(r):
    return [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256]


def test_every_column_equals_plain_loops(docs_of, tool):
    want, _ = expected(tool, TEXTS)
    got = {r.doc_id: as_row(r) for r in X.align_documents(docs_of(list(enumerate(TEXTS))).repartition(5), A_FILE, MODEL_FILE).collect()}
    assert [got[i] for i in range(len(TEXTS))] == want
    assert want[7][0] == 0  # the mark for a space doesn't come back as itself


def test_given_documents(spark, small, tool):
    from penalytics.llm.common import table
    from penalytics.llm.queries import op11_token_alignment
    rows = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    short = {i: t for i, t in rows.items() if len(t) < 3000}
    want, _ = expected(tool, list(short.values()))
    got = {r.doc_id: r for r in op11_token_alignment(spark, small).collect()}
    assert sorted(got) == sorted(rows)
    assert [as_row(got[i])[:4] + [got[i].groups_sha256] for i in short] == [w[:4] + w[6:] for w in want]


def test_small_blocks_and_large_groups_change_nothing(docs_of, tool, monkeypatch):
    texts = [t for t in TEXTS if t] * 2
    want, holds = expected(tool, texts)
    for name, value in (("CHUNK_BYTES", 30), ("BLOCK_BYTES", 60), ("BLOCK_ROWS", 2), ("LARGE_GROUP", 1)):
        monkeypatch.setattr(X, name, value)
    pairs, rows = Counter(), []
    for part in X._chunks(texts):
        found, own = X._digest(tool, texts[part])
        pairs.update(own.tolist())
        rows += found[["n_a", "n_b", "n_groups", "n_links"]].values.tolist()
    assert rows == [w[:4] for w in want]
    assert pairs == Counter({i * tool.width + j: n for (i, j), n in holds.items()})


def test_full_alignments(docs_of, tool):
    got = {r.doc_id: r for r in X.alignments(docs_of(list(enumerate(TEXTS))), A_FILE, MODEL_FILE).collect()}
    for i, text in enumerate(TEXTS):
        a, b, groups, over = plain(tool, text)
        r = got[i]
        assert (r.a_ids, r.b_ids) == (a, b)
        assert [(o.a, o.b) for o in r.overlaps] == over
        ends, p, q, size = [], 0, 0, 0
        for x, y in groups:
            p, q, size = p + len(x), q + len(y), size + sum(len(tool.sides[0].pieces[k]) for k in x)
            ends.append((p, q, size))
        assert [(g.a_end, g.b_end, g.byte_end) for g in r.groups] == ends


def test_link_counts(docs_of, tool):
    _, holds = expected(tool, TEXTS)
    got = X.link_counts(docs_of(list(enumerate(TEXTS))).repartition(3), A_FILE, MODEL_FILE).collect()
    assert {(r.a_id, r.b_id): r.n_docs for r in got} == dict(holds)
    best = {}
    for (i, _), n in holds.items():
        best[i] = max(best.get(i, 0), n)
    assert all(r.best == (r.n_docs == best[r.a_id]) for r in got)


def test_both_libraries_cut_alike_below_the_bound(tool):
    side = tool.sides[0]
    assert side.quick is not None
    texts = [f"{c}{other}{c}{c} {c}a{c}1" for c in map(chr, range(ord(X.SAME_BELOW))) for other in ("a", "1", " ", "-", "é", "\n", "'s", "")]
    for t in texts:
        assert side.encode([t])[0].tolist() == side.library.encode(" " + t, add_special_tokens=False).ids, repr(t)


def test_nulls_repeats_and_very_long_texts(docs_of, tool):
    long = "word " * 200_000
    rows = [(1, None), (1, None), (None, "a b"), (2, "a b"), (2, "a b"), (3, long), (4, "z" * 400_000), (5, " " * 100_000)]
    got = X.align_documents(docs_of(rows), A_FILE, MODEL_FILE).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(tuple(as_row(r)))
    assert all(len(s) == 1 for s in by.values())
    assert by[1] == {(0, 0, 0, 0, 0, 0, "")} and by[None] == by[2]
    a, b = tool.sides[0].library.encode(" " + long, add_special_tokens=False).ids, tool.sides[1].library.encode(long)
    assert next(iter(by[3]))[:2] == (len(a), len(b))


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b", 5, "x")], "id long, body string, block int, pairs string")
    assert [r.doc_id for r in X.align_documents(rows, A_FILE, MODEL_FILE, "id", "body").collect()] == [1]
