"""The additive model: features against plain counting, trees against brute force, held-out accuracy."""
import math
import unicodedata
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pytest

from penalytics.llm import quality_gam as X
from penalytics.llm.common import table
from penalytics.llm.queries import op12_quality_gam


def plain(text):
    """The features by loops."""
    text = text or ""
    n = len(text)

    def kind(c):
        k = unicodedata.category(c)
        if c in "\t\n\v\f\r" or k[0] == "Z":
            return "space"
        if c in ".?!…。？！":
            return "sentence"
        if c in ",;:'\"-()" or k in ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf"):
            return "mark"
        return {"Lu": "upper", "Lt": "upper", "Ll": "lower", "Lo": "lower", "Lm": "lower", "Nd": "digit", "Nl": "digit",
                "No": "digit", "Mn": "accent", "Mc": "accent"}.get(k, "other")

    kinds = [kind(c) for c in text]
    c = Counter(kinds)
    words = [[p[0] for p in g] for ink, g in groupby(zip(text, kinds), lambda p: p[1] != "space") if ink]
    words = ["".join(w) for w in words]
    wk = [[kind(x) for x in w] for w in words]
    m = len(words)
    div = lambda a, b: a / b if b else 0.0
    sizes = [len(w) for w in words]
    mean = div(sum(sizes), m)
    pairs = list(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    total = sum(map(len, lines))
    cells = Counter(ord(x) % 256 for x in text)
    letters = [sum(k in ("upper", "lower") for k in ks) for ks in wk]
    uppers = [ks.count("upper") for ks in wk]
    return [math.log1p(n), div(c["upper"] + c["lower"], n), div(c["upper"], c["upper"] + c["lower"]), div(c["digit"], n),
            div(c["space"], n), div(c["sentence"], n), div(c["mark"], n), div(c["other"], n),
            div(sum(a == b for a, b in zip(text, text[1:])), n), math.log1p(m), mean,
            math.sqrt(max(0, div(sum(s * s for s in sizes), m) - mean ** 2)), div(sum(s <= 3 for s in sizes), m),
            div(sum(s > 12 for s in sizes), m), div(sum(ks[0] == "upper" for ks in wk), m),
            div(sum(u == k and u > 1 for u, k in zip(uppers, letters)), m), div(sum(k == 0 for k in letters), m),
            div(sum(ks[-1] == "other" for ks in wk), m), div(sum(ks[-1] in ("sentence", "mark") for ks in wk), m),
            div(len(set(words)), m), div(max(Counter(words).values(), default=0), m), div(len(set(pairs)), len(pairs)),
            math.log1p(len(lines)), math.log1p(div(total, len(lines))), div(total - sum(map(len, set(lines))), total),
            div(sum(kind(x[-1]) == "sentence" for x in lines), len(lines)),
            -sum(v / n * math.log2(v / n) for v in cells.values()) if n else 0.0]


TEXTS = ["", None, "a", " ", "\n\n", "One line.\nOne line.\nTwo!", "SHOUT!! NOW!! A1 22 $$$ a%%%", "né Äé ß ́x ﬁ", "早上去了图书馆。 ok",
         "x y x y x y", "\tlead and trail \n", "a\nb", "word " * 50, "\U0001F600 smile"]


def test_features_equal_plain_counting():
    got = X.features(TEXTS)
    for k, text in enumerate(TEXTS):
        np.testing.assert_allclose(got[k], plain(text), atol=1e-9, err_msg=repr(text))


def test_features_do_not_depend_on_company(monkeypatch):
    alone = np.concatenate([X.features([t]) for t in TEXTS])
    monkeypatch.setattr(X, "CHUNK", 10)
    np.testing.assert_allclose(X.features(TEXTS), alone, atol=1e-12)


def test_given_documents(spark, small):
    texts = [r.text for r in table(spark, small, "documents").limit(60).collect()]
    np.testing.assert_allclose(X.features(texts), [plain(t) for t in texts], atol=1e-9)


def test_cut_points_part_the_values():
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 5, 100), rng.normal(size=1000), np.zeros(10), np.array([1.0])):
        e = X.cut_points(values.astype(float), 8)
        assert len(e) <= 7 and not np.isin(e, values).any()
        assert (np.diff(e) > 0).all()


def test_first_cut_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.uniform(0.5, 3, 9)
        step = X.shallow_tree(g, h, depth=1, least=0.0)

        def value(k):
            return sum(s[0].sum() ** 2 / (s[1].sum() + 1) for s in ((g[:k], h[:k]), (g[k:], h[k:])))

        k = max(range(1, 9), key=value)
        if value(k) > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            want = np.repeat([-g[:k].sum() / (h[:k].sum() + 1), -g[k:].sum() / (h[k:].sum() + 1)], [k, 9 - k])
            np.testing.assert_allclose(step, want)


def test_grid_tree_gain_is_the_best_of_all():
    rng = np.random.default_rng(3)
    for _ in range(20):
        g, h = rng.normal(size=(4, 3)), rng.uniform(2, 5, (4, 3))
        step, gain = X.grid_tree(g, h, least=0.0)
        assert step.shape == g.shape

        def leaf(a, b):
            return a.sum() ** 2 / (b.sum() + 1) / 2

        def halves(a, b):
            return max([leaf(a, b)] + [leaf(a[:, :k], b[:, :k]) + leaf(a[:, k:], b[:, k:]) for k in range(1, a.shape[1])])

        both = [max(halves(a[:k], b[:k]) + halves(a[k:], b[k:]) for k in range(1, len(a))) for a, b in ((g, h), (g.T, h.T))]
        assert gain == pytest.approx(max(both))


def test_learns_an_interaction():
    """A label that no single feature tells: one pair of features does."""
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (4000, 4))
    y = (x[:, 0] * x[:, 2] > 0).astype(float)
    check = np.arange(4000) % 6 == 0
    alone, paired = (X.fit_model(x, y, check, n_pairs=n) for n in (0, 3))
    fresh = rng.uniform(-1, 1, (1000, 4))
    right = [((m.score(fresh) > 0.5) == (fresh[:, 0] * fresh[:, 2] > 0)).mean() for m in (alone, paired)]
    assert right[0] < 0.65 and right[1] > 0.9
    assert paired.pairs[0][:2] == (0, 2)


def test_held_out_accuracy_and_batches(spark):
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op12_quality_gam(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    assert len(got) == table(spark, folder, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(labels[i], r.predicted) for i, r in got.items() if i in labels and r.held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_do_not_matter(spark, docs_of):
    rows = [(i, ("ok words here. " if i % 3 else "$$$ %%% ") * (i % 7 + 1)) for i in range(200)]
    labels = [(i, int(i % 3 > 0)) for i in range(200)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    made = [sorted(map(tuple, X.score_documents(docs_of(rows), spark.createDataFrame(x, "doc_id long, quality int")).collect()))
            for x in (labels, turned)]
    assert made[0] == made[1]


def test_odd_labels_nulls_repeats_and_long_texts(spark, docs_of):
    rows = [(i, "fine words here." if i % 2 else "@@@ $$$") for i in range(60)] + [(1, "fine words here."), (None, None), (None, ""), (70, "é" * 500_000)]
    labels = [(i, i % 2) for i in range(60)] + [(1, 1), (2, None), (None, 1), (3, 7), (4, 1)]
    found = X.score_documents(docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    same = {r.score for r in found if r.doc_id == 1}
    assert len(same) == 1 and len({r.score for r in found if r.doc_id is None}) == 1
    assert not any(r.held_out for r in found if r.doc_id is None)


def test_without_labels_or_with_one_kind(spark, docs_of):
    docs = docs_of([(1, "a"), (2, None)])
    for rows, want in (([], 0.5), ([(1, 1)], 1.0), ([(2, 0)], 0.0)):
        found = X.score_documents(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
        assert all(r.score == pytest.approx(want, abs=1e-6) for r in found)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 0.1, "x", 3)], "doc_id long, text string, score double, y string, id long")
    labels = spark.createDataFrame([(1, 1, "t")], "doc_id long, quality int, text string")
    assert X.score_documents(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"]
