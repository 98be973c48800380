"""Language identification by multilingual mixture inference.

A document is taken as a bag of character n-grams (orders 1 to 3) drawn from a
mixture of languages. Expectation-maximisation finds the proportions that
maximise its likelihood; the set of languages is the one with the best
likelihood after a penalty for each further language. The prediction is the
language with the largest proportion in that set.

The n-gram probabilities are learned by a Spark job from labelled rows: per
language about ``fit_docs`` documents, chosen by a hash of their id (the
documented bound of the fit). N-grams are hashed to ``BUCKETS`` counters, so
the model has a fixed size for each language, whatever the corpus holds.

How well the set explains a text is its mean log-likelihood per n-gram. The bound lies
half-way between that of the labelled texts (each n-gram left out of its own count) and
that of a background in which all buckets are alike, less two standard errors of a text
of that length, so gibberish and unlearned languages fall below it and short texts don't.

Defined results: a null text, or one without any letter, is ``und`` with score
0. Without any labelled row nothing is learned and every text is ``und``. Equal
texts, repeated rows among them, get equal results; ties go to the language that comes first.
Very long texts are counted whole. An empty table gives no rows. Columns other than the
text are never looked at, and pass the filter whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare_workers, shielded

BUCKETS = 1 << 15
ORDERS = 3
UNKNOWN = "und"
RESULT = "lang string, score double, languages array<string>, proportions array<double>, explained boolean"
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters; built once in each Python worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
    return _LETTERS


def gram_buckets(text: str | None) -> np.ndarray:
    """Bucket of every n-gram of the letters of ``text``; words are set off by one space each."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    is_letter = _letters()[points] if len(points) else np.zeros(0, bool)
    if not is_letter.any():
        return np.zeros(0, np.int64)
    points = np.concatenate(([32], np.where(is_letter, points, 32), [32])).astype(np.uint32)
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    found, code = [], np.zeros(len(points), np.uint32)
    for order in range(ORDERS):
        code = code[: len(points) - order] * np.uint32(0x01000193) + points[order:]
        mixed = (code ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        found.append((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1))
    return np.concatenate(found).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """log P(bucket | language), one row for each bucket; as large as BUCKETS x languages."""

    languages: tuple[str, ...]
    logp: np.ndarray
    #: Mean log-likelihood of a labelled n-gram of each language, and its standard deviation.
    typical: np.ndarray | None = None
    spread: np.ndarray | None = None

    def mixture(self, text: str | None, penalty: float = 5.0, rounds: int = 40) -> list[tuple[str, float]]:
        """Languages of a text with their proportions, largest first; empty for ``und``."""
        return self.judge(text, penalty, rounds)[0]

    def explains(self, mean: float, grams: int, chosen: list[int], share: np.ndarray) -> bool:
        """Whether a mean log-likelihood is one of a text in the mixture; a model no better than the background can't tell."""
        if self.typical is None:
            return True
        typical, background = float(self.typical[chosen] @ share), -np.log(BUCKETS)
        # the n-grams of all orders at one place are one observation
        error = float(self.spread[chosen] @ share) / np.sqrt(grams / ORDERS)
        return typical <= background or mean >= (typical + background) / 2 - 2 * error

    def judge(self, text: str | None, penalty: float = 5.0, rounds: int = 40) -> tuple[list[tuple[str, float]], bool]:
        """Languages of a text with their proportions, and whether they explain it."""
        grams = gram_buckets(text)
        if not len(grams) or not self.languages:
            return [], False
        counts = np.bincount(grams, minlength=BUCKETS)
        seen = np.flatnonzero(counts)
        counts, logp = counts[seen].astype(float), self.logp[seen]
        single = counts @ logp
        best = int(single.argmax())
        if len(self.languages) == 1:
            return [(self.languages[0], 1.0)], self.explains(single[0] / len(grams), len(grams), [0], np.ones(1))
        price = penalty * np.log(len(grams))
        # The likelihood is concave in the proportions: its gradient at one pure
        # language bounds what any mixture can gain, so most texts need no EM.
        ratio = np.exp(np.minimum(logp - logp[:, [best]], 50.0))
        if (counts @ ratio).max() - counts.sum() <= price:
            near = np.exp((single - single[best]) / ORDERS)
            explained = self.explains(single[best] / len(grams), len(grams), [best], np.ones(1))
            return [(self.languages[best], float(1.0 / near.sum()))], explained
        p = np.exp(logp - logp.max(axis=1, keepdims=True))
        order = np.argsort(-expectation_maximisation(p, counts, rounds), kind="stable")
        order = [best, *(int(i) for i in order if i != best)]
        top, chosen, share = single[best], [best], np.ones(1)
        base = counts @ logp.max(axis=1)
        for k in range(2, len(order) + 1):
            pi = expectation_maximisation(p[:, order[:k]], counts, rounds)
            value = base + counts @ np.log(p[:, order[:k]] @ pi) - price * (k - 1)
            if value <= top:
                break
            top, chosen, share = value, order[:k], pi
        pairs = sorted(zip(chosen, share), key=lambda x: (-x[1], x[0]))
        mean = (top + price * (len(chosen) - 1)) / len(grams)
        return [(self.languages[i], float(w)) for i, w in pairs], self.explains(mean, len(grams), chosen, share)


def expectation_maximisation(p: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions of the columns of ``p`` (n-gram likelihoods) that best explain ``counts``."""
    pi = np.full(p.shape[1], 1.0 / p.shape[1])
    for _ in range(rounds):
        new = pi * (p.T @ (counts / np.maximum(p @ pi, 1e-300))) / counts.sum()
        if np.abs(new - pi).max() < 1e-4:
            return new / new.sum()
        pi = new
    return pi / pi.sum()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            mine = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            mine += np.bincount(gram_buckets(text), minlength=BUCKETS)
    for lang, counts in totals.items():
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": seen, "n": counts[seen]})


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        fit_docs: int = 4000, alpha: float = 0.5) -> LanguageModel:
    """Learn from labelled rows; about ``fit_docs`` of each language, by a hash of the id."""
    prepare_workers(rows.sparkSession)
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel((), np.zeros((BUCKETS, 0)))
    share = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(False)
    for lang, n in sizes.items():
        wanted = wanted | ((F.col("lang") == lang) & (share < min(1.0, fit_docs / n)))
    counted = rows.where(wanted).select("lang", "text").mapInPandas(_count, "lang string, bucket long, n long")
    counts = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(set(counts["lang"])))
    table = np.zeros((BUCKETS, len(languages)))
    for j, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        table[own["bucket"].to_numpy(np.int64), j] = own["n"]
    total = np.maximum(table.sum(axis=0), 1)
    # each n-gram by the model without it, as in a text that the fit hasn't seen
    without = np.log((np.maximum(table - 1, 0) + alpha) / (total - 1 + alpha * BUCKETS))
    typical = (table * without).sum(axis=0) / total
    spread = np.sqrt((table * (without - typical) ** 2).sum(axis=0) / total)
    table += alpha
    return LanguageModel(languages, np.log(table / table.sum(axis=0)), typical, spread)


def identify(text: Column, model: LanguageModel, spark) -> Column:
    """Struct ``RESULT`` for a text column; the model is sent to executors once."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        judged = [shared.value.judge(t) for t in texts]
        found = [x for x, _ in judged]
        return pd.DataFrame({
            "lang": [x[0][0] if x else UNKNOWN for x in found],
            "score": [min(1.0, max(0.0, x[0][1])) if x else 0.0 for x in found],
            "languages": [[a for a, _ in x] for x in found],
            "proportions": [[b for _, b in x] for x in found],
            "explained": [bool(e) for _, e in judged]})

    return predict(text)


def held_out(doc_id: Column) -> Column:
    """Documents that the fit never sees: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, proportions of every document."""
    prepare_workers(docs.sparkSession)
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                      identify(F.col("text"), model, docs.sparkSession).alias("r"))
    return out.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), "r.score",
                      "r.languages", "r.proportions")


def keep_identified(docs: DataFrame, least_score: float = 0.2) -> DataFrame:
    """Rows of ``docs`` in known languages that explain the text, with a score of ``least_score`` or more.

    Rejected: null texts, texts without a letter, texts that no set of the known
    languages explains, and mixtures in which no language reaches that share (with
    five languages or fewer one always does). Where nothing could be learned (no labelled rows),
    only texts without a letter go.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    plain, (i, t, lang) = shielded(docs, "doc_id", "text", "lang")
    model = fit(plain.where(~held_out(F.col(i))), i, t, lang)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = plain.withColumn("__x_lang", identify(F.col(t), model, spark))
    found = found.where(f"__x_lang.lang <> '{UNKNOWN}' and __x_lang.explained and __x_lang.score >= {float(least_score)}")
    return found.select(*plain.columns).toDF(*docs.columns)
