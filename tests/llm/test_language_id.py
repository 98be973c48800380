"""Held-out accuracy, mixtures, and what is never looked at."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from penalytics.llm import language_id as L


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return L.fit(documents.where(~L.held_out(F.col("doc_id"))))


def test_held_out_accuracy(documents):
    import zlib
    lang = {r.doc_id: r.lang for r in documents.collect()}
    found = L.predict_documents(documents).collect()
    assert sorted(r.doc_id for r in found) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    right = [r.lang_pred == lang[r.doc_id] for r in found if r.held_out]
    assert np.mean(right) >= 0.98 and all(0 <= r.score <= 1 for r in found)


def test_labels_of_held_out_rows_do_not_matter(documents):
    other = documents.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    a, b = ({(r.doc_id, r.lang_pred, r.score) for r in L.predict_documents(d).collect()} for d in (documents, other))
    assert a == b


def test_mixture(documents, model):
    texts = {r.lang: r.text for r in documents.where("length(text) > 3000").orderBy("doc_id").collect()}
    mixed = texts["en"][:1500] + " " + texts["de"][:500]
    found = dict(model.mixture(mixed))
    assert set(found) == {"en", "de"} and 0.65 < found["en"] < 0.85
    assert [a for a, _ in model.mixture(texts["fr"])] == ["fr"]


def test_em_maximises_the_likelihood():
    rng = np.random.default_rng(3)
    p, counts = rng.random((50, 2)), rng.integers(1, 9, 50).astype(float)
    best = max(np.linspace(0, 1, 2001), key=lambda x: counts @ np.log(p @ [x, 1 - x] + 1e-300))
    assert L.expectation_maximisation(p, counts, 2000)[0] == pytest.approx(best, abs=0.02)


def test_nulls_ties_and_odd_texts(spark, documents, model):
    rows = [(1, None), (1, None), (2, ""), (3, "12 .,\n"), (None, "the of and"), (4, "ab " * 100_000), (5, "日本語")]
    odd = spark.createDataFrame([(i, t, "en", "x", 0, "c") for i, t in rows],
                                "doc_id long, text string, lang string, source string, n_chars long, lang_pred string")
    both = documents.withColumn("lang_pred", F.lit("c")).unionByName(odd)
    found = L.predict_documents(both).where("doc_id is null or doc_id <= 5").collect()
    by = {(r.doc_id, r.lang_pred) for r in found}
    assert {(1, "und"), (2, "und"), (3, "und")} <= by and sum(r.doc_id is None for r in found) == 1
    assert not [r for r in found if r.doc_id is None][0].held_out
    kept = L.keep_identified(both)
    assert kept.columns == both.columns and kept.where("text is null or not text rlike '\\\\p{L}'").count() == 0


def test_no_labels(spark, docs_of):
    docs = docs_of([(1, "words"), (2, None), (3, "12")], lang=None)
    assert {(r.doc_id, r.lang_pred, r.score) for r in L.predict_documents(docs).collect()} == {
        (1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)}
    assert [r.doc_id for r in L.keep_identified(docs).collect()] == [1]


def test_texts_that_no_language_explains_are_rejected(documents, model):
    import random
    rng = random.Random(4)
    rows = documents.limit(60).collect()
    odd = {
        1: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(600)),
        2: "xkcd qzrt wvbn plkj hgfd zxcv " * 9,
        3: "Это текст статьи, написанной на русском языке, и в ней есть всё, что нужно. " * 3,
        4: "Wszystkie dzieci chętnie czytają ciekawe książki, których bohaterowie podróżują przez odległe krainy. " * 2,
        5: "これは日本語の文章です。天気と自然について書いてあります。" * 3,
    }
    short = {k: t for k, t in enumerate(("the end of it and all", "Hello there", "Das Museum hat heute geschlossen.", "la casa de los libros"), 10)}
    spark = documents.sparkSession
    more = spark.createDataFrame([(-k, t, None, "x", 0) for k, t in (odd | short).items()],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in L.keep_identified(documents.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)).collect()}
    assert kept & {-k for k in odd} == set() and {-k for k in short} <= kept
    assert {r.doc_id for r in rows if r.text and any(c.isalpha() for c in r.text)} <= kept
