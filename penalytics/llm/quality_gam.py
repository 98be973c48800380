"""Text quality by a generalised additive model with pairwise interactions.

A text's features are shares and sizes of its characters, words and lines (``FEATURES``).
Each feature is cut into bins at quantiles of the fitted rows. Cyclic boosting visits the
features in turn, again and again: a tree of depth 2 over one feature's bins is fitted to
the log loss's gradients and curvatures and, times a small rate, added to that feature's
lookup table. The pairs that explain most of what is left then get tables over two features'
coarser bins in the same way. A hashed part of the fitted rows stops either pass. A score is
the logistic function of an intercept and one table entry for each feature and pair, looked
up and added for a batch at once.

The fit takes about ``fit_rows`` labelled documents, chosen by a hash of their id (the
documented bound): their features come from a Spark job, which is all that reaches the
driver. Scoring is one narrow pass over all texts; the model has a fixed size.

Defined results: null and empty texts are texts without characters, and get the score of
these features. A document with several labels has their mean; labels that are null, not
in [0, 1] or without an id are left out; of several documents with one id, the one with the
smallest features is learned from. Without labels of both kinds every score is the labels'
mean, or 0.5 without any. Repeated rows and ties get equal scores. Very long texts are
measured alone, whole; their arrays are a few times the text. Empty tables give empty
results. Only the id and text columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare_workers

#: Characters that are measured together.
CHUNK = 1 << 19
#: Character classes.
OTHER, LOWER, UPPER, DIGIT, SPACE, SENTENCE, PUNCTUATION, MARKS = range(8)
FEATURES = (
    "log_chars", "letters", "upper_of_letters", "digits", "spaces", "sentence_marks", "punctuation", "symbols", "repeated_neighbours",
    "log_words", "word_length", "word_length_spread", "short_words", "long_words", "capital_words", "shouted_words",
    "words_without_letters", "words_ending_in_symbols", "words_ending_in_marks", "distinct_words", "commonest_word", "distinct_pairs",
    "log_lines", "line_length", "repeated_lines", "lines_ended", "character_entropy")
_CLASSES: np.ndarray | None = None


def _classes() -> np.ndarray:
    """The class of every code point; built once in each Python worker."""
    global _CLASSES
    if _CLASSES is None:
        kinds = {"Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Nl": DIGIT, "No": DIGIT, "Zs": SPACE, "Zl": SPACE, "Zp": SPACE, "Mn": MARKS, "Mc": MARKS}
        kinds |= {k: LOWER for k in ("Ll", "Lo", "Lm")} | {k: PUNCTUATION for k in ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf")}
        found = np.fromiter((kinds.get(unicodedata.category(chr(i)), OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        found[[ord(c) for c in "\t\n\v\f\r"]] = SPACE
        found[[ord(c) for c in ".?!…。？！"]] = SENTENCE
        found[[ord(c) for c in ",;:'\"-()"]] = PUNCTUATION
        _CLASSES = found
    return _CLASSES


def _run_keys(points: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A 64-bit key of each run of characters (first to last, excluded) within its document."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = last - first
    powers = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(first, size) + inside
    sums = np.add.reduceat((points[at].astype(np.uint64) + np.uint64(1)) * powers[inside], np.cumsum(size) - size)
    sums ^= sums >> np.uint64(29)
    return (sums + doc.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) + doc.astype(np.uint64) * np.uint64(0x94D049BB133111EB)


def _first_of_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key stands first, and how often it occurs."""
    _, at, n = np.unique(keys, return_index=True, return_counts=True)
    return at, n


def _measure(texts: list[str]) -> np.ndarray:
    n = len(texts)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(n), lengths)
    kind = _classes()[points]
    by_class = np.bincount(doc * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    first_of_doc = np.zeros(len(points) + 1, bool)
    first_of_doc[np.cumsum(lengths) - lengths] = True
    first_of_doc = first_of_doc[:-1]
    count = lambda where: np.bincount(where, minlength=n).astype(float)
    share = lambda part, whole: np.divide(part, whole, out=np.zeros(n), where=whole > 0)
    chars = lengths.astype(float)

    ink = kind != SPACE
    before = np.concatenate(([False], ink[:-1])) & ~first_of_doc
    after = np.concatenate((ink[1:], [False])) & ~np.concatenate((first_of_doc[1:], [True])) if len(ink) else ink
    start, stop = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    word_doc, size = doc[start], (stop - start).astype(float)
    words = count(word_doc)
    summed = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    letters_to, upper_to = summed((kind == LOWER) | (kind == UPPER)), summed(kind == UPPER)
    word_letters, word_upper = letters_to[stop] - letters_to[start], upper_to[stop] - upper_to[start]
    mean_size = share(np.bincount(word_doc, size, n), words)
    spread = np.sqrt(np.maximum(share(np.bincount(word_doc, size * size, n), words) - mean_size ** 2, 0))
    last_kind = kind[stop - 1]
    keys = _run_keys(points, start, stop, word_doc)
    at, times = _first_of_equal(keys)
    commonest = np.zeros(n)
    np.maximum.at(commonest, word_doc[at], times)
    pair_doc = word_doc[:-1][word_doc[1:] == word_doc[:-1]]
    pairs = (keys[:-1] * np.uint64(0x9E3779B97F4A7C15) + keys[1:])[word_doc[1:] == word_doc[:-1]]
    pair_at, _ = _first_of_equal(pairs)

    end = np.flatnonzero((points == 10) | np.concatenate((first_of_doc[1:], [True]))) if len(points) else np.zeros(0, np.int64)
    begin = np.concatenate((np.zeros(min(1, len(end)), np.int64), end[:-1] + 1))
    end = np.where(points[end] == 10, end, end + 1)
    full = end > begin
    begin, end = begin[full], end[full]
    line_doc, line_size = doc[begin], (end - begin).astype(float)
    lines = count(line_doc)
    line_at, _ = _first_of_equal(_run_keys(points, begin, end, line_doc))
    fresh = np.bincount(line_doc[line_at], line_size[line_at], n)
    in_lines = np.bincount(line_doc, line_size, n)

    same = np.flatnonzero((points[1:] == points[:-1]) & ~first_of_doc[1:])
    cells = np.bincount(doc * 256 + points % 256, minlength=256 * n).reshape(n, 256) / np.maximum(chars, 1)[:, None]
    entropy = -(cells * np.log2(np.where(cells > 0, cells, 1))).sum(axis=1)
    letters = by_class[:, LOWER] + by_class[:, UPPER]
    return np.column_stack((
        np.log1p(chars), share(letters, chars), share(by_class[:, UPPER], letters), share(by_class[:, DIGIT], chars),
        share(by_class[:, SPACE], chars), share(by_class[:, SENTENCE], chars), share(by_class[:, PUNCTUATION], chars),
        share(by_class[:, OTHER], chars), share(count(doc[same]), chars),
        np.log1p(words), mean_size, spread, share(count(word_doc[size <= 3]), words), share(count(word_doc[size > 12]), words),
        share(count(word_doc[kind[start] == UPPER]), words), share(count(word_doc[(word_upper == word_letters) & (word_upper > 1)]), words),
        share(count(word_doc[word_letters == 0]), words), share(count(word_doc[last_kind == OTHER]), words),
        share(count(word_doc[(last_kind == SENTENCE) | (last_kind == PUNCTUATION)]), words),
        share(count(word_doc[at]), words), share(commonest, words), share(count(pair_doc[pair_at]), count(pair_doc)),
        np.log1p(lines), np.log1p(share(in_lines, lines)), 1 - share(fresh, np.maximum(in_lines, 1)) - (in_lines == 0),
        share(count(line_doc[kind[end - 1] == SENTENCE]), lines), entropy))


def features(texts: list[str | None]) -> np.ndarray:
    """``FEATURES`` of each text, a row each; what a text is measured with doesn't matter."""
    texts = [t if isinstance(t, str) else "" for t in texts]
    parts, first, size = [np.zeros((0, len(FEATURES)))], 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t) > CHUNK:
            parts.append(_measure(texts[first:k]))
            first, size = k, 0
        size += len(t)
    if texts:
        parts.append(_measure(texts[first:]))
    return np.concatenate(parts)


# ---------------------------------------------------------------- the model

@dataclass
class AdditiveModel:
    """Bin edges of each feature, its table, and tables of pairs over coarser bins."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (e, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(e, x[:, j], "right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Edges between up to ``bins`` bins, at quantiles of the values (half-way between neighbours that differ)."""
    v = np.sort(values)
    at = np.unique(np.linspace(0, len(v), bins + 1).astype(int)[1:-1])
    at = at[(at > 0) & (at < len(v))]
    low = v[at - 1]
    above = np.searchsorted(v, low, "right")
    ok = above < len(v)
    return np.unique((low[ok] + v[above[ok]]) / 2)


def _best_cut(g: np.ndarray, h: np.ndarray, least: float, smooth: float) -> tuple[float, int]:
    """Gain and place of the best split of bins with gradient sums g and curvature sums h."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl ** 2 / (hl + smooth) + gr ** 2 / (hr + smooth), -np.inf)
    if not len(gain) or not np.isfinite(gain.max()):
        return 0.0, -1
    k = int(gain.argmax())
    return float(gain[k] - g.sum() ** 2 / (h.sum() + smooth)), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2, least: float = 0.3, smooth: float = 1.0) -> np.ndarray:
    """A step for each bin: the Newton steps of the leaves of a tree over bins in order."""
    out = np.zeros(len(g))

    def grow(lo: int, hi: int, left: int) -> None:
        gain, k = _best_cut(g[lo:hi], h[lo:hi], least, smooth) if left else (0.0, -1)
        if k < 0 or gain <= 1e-9:
            out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + smooth)
            return
        grow(lo, lo + k, left - 1)
        grow(lo + k, hi, left - 1)

    grow(0, len(g), depth)
    return out


def grid_tree(g: np.ndarray, h: np.ndarray, least: float = 0.3, smooth: float = 1.0) -> tuple[np.ndarray, float]:
    """A step for each cell of two features' bins, and its gain: the best cut along one, then one of each side along the other."""
    best: tuple[float, np.ndarray] = (-np.inf, np.zeros_like(g))
    for turn in (0, 1):
        a, b = (g, h) if not turn else (g.T, h.T)
        ca, cb = np.cumsum(a, axis=0), np.cumsum(b, axis=0)
        for k in range(len(a) - 1):
            sides = ((ca[k], cb[k]), (ca[-1] - ca[k], cb[-1] - cb[k]))
            if min(s[1].sum() for s in sides) < least:
                continue
            steps, value = np.zeros_like(a), 0.0
            for (sg, sh), rows in zip(sides, (slice(0, k + 1), slice(k + 1, None))):
                step = shallow_tree(sg, sh, 1, least, smooth)
                steps[rows] = step
                value -= (step * sg).sum() / 2  # a leaf's gain is half its gradient times its step
            if value > best[0]:
                best = (value, steps if not turn else steps.T)
    return best[1], best[0]


def _loss(y: np.ndarray, f: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, f) - y * f))


def _boost(cells: list[np.ndarray], sizes: list[int], y: np.ndarray, f: np.ndarray, check: np.ndarray, rounds: int, rate: float,
           patience: int, step) -> tuple[list[np.ndarray], np.ndarray]:
    """Cyclic boosting of one table for each array of cell numbers; f: margins so far. The best round on ``check`` counts."""
    tables = [np.zeros(s) for s in sizes]
    learn = ~check if check.any() else np.ones(len(y), bool)
    own, yl, fl = [c[learn] for c in cells], y[learn], f[learn].copy()
    fc, other = f[check].copy(), [c[check] for c in cells]
    best, kept, since = _loss(y[check], fc) if check.any() else np.inf, [t.copy() for t in tables], 0
    for _ in range(rounds):
        for k, (c, size) in enumerate(zip(own, sizes)):
            p = 1 / (1 + np.exp(-fl))
            add = rate * step(k, np.bincount(c, p - yl, size), np.bincount(c, p * (1 - p), size))
            tables[k] += add
            fl += add[c]
            fc += add[other[k]]
        now = _loss(y[check], fc) if check.any() else -np.inf
        if now < best - 1e-7 or not check.any():
            best, kept, since = now, [t.copy() for t in tables], 0
        elif (since := since + 1) >= patience:
            break
    out = f.copy()
    for t, c in zip(kept, cells):
        out += t[c]
    return kept, out


def fit_model(x: np.ndarray, y: np.ndarray, check: np.ndarray, bins: int = 64, coarse_bins: int = 12, rounds: int = 400,
              rate: float = 0.1, n_pairs: int = 10, patience: int = 15) -> AdditiveModel:
    """x: a row of features each; y: labels in [0, 1]; check: rows that stop the boosting instead of being learned from."""
    d = x.shape[1]
    mean = float(y.mean()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return AdditiveModel([np.zeros(0)] * d, [np.zeros(0)] * d, float(np.log(max(mean, 1e-9) / max(1 - mean, 1e-9))), [np.zeros(1)] * d, [])
    edges = [cut_points(x[:, j], bins) for j in range(d)]
    coarse = [cut_points(x[:, j], coarse_bins) for j in range(d)]
    start = float(np.log(mean / (1 - mean)))
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables, f = _boost(fine, [len(e) + 1 for e in edges], y, np.full(len(y), start), check, rounds, rate, patience,
                       lambda k, g, h: shallow_tree(g, h))
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    p = 1 / (1 + np.exp(-f))
    learn = ~check
    found = []
    for i, j in combinations(range(d), 2):
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        if min(shape) > 1:
            c = (rough[i] * shape[1] + rough[j])[learn]
            g, h = (np.bincount(c, w[learn], shape[0] * shape[1]).reshape(shape) for w in (p - y, p * (1 - p)))
            found.append((grid_tree(g, h)[1], i, j, shape))
    found = sorted(found, key=lambda t: (-t[0], t[1:3]))[:n_pairs]
    cells = [rough[i] * s[1] + rough[j] for _, i, j, s in found]
    shapes = [s for *_, s in found]
    both, _ = _boost(cells, [a * b for a, b in shapes], y, f, check, rounds, rate, patience,
                     lambda k, g, h: grid_tree(g.reshape(shapes[k]), h.reshape(shapes[k]))[0].ravel())
    return AdditiveModel(edges, coarse, start, tables, [(i, j, t.reshape(s)) for (_, i, j, s), t in zip(found, both)])


# ---------------------------------------------------------------- Spark

def held_out(doc_id: Column) -> Column:
    """Documents that the fit never sees: crc32 of the id as text divides by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _features_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(features(texts.tolist())))

    return run(text.cast("string"))


def labelled(labels: DataFrame, fit_rows: int, label_col: str = "quality") -> DataFrame:
    """(id, y) of about ``fit_rows`` labelled ids that aren't held out, by a hash of the id."""
    label = F.col(label_col).cast("double")
    rows = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & label.between(0, 1))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg(label).alias("y"))
    n = rows.count()
    share = F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(share < min(1.0, fit_rows / max(n, 1)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 40_000, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", **options) -> AdditiveModel:
    """Learn from labelled documents; ``labels`` has columns doc_id and ``label_col``."""
    prepare_workers(docs.sparkSession)
    # about fit_rows rows of an id and a label
    wanted = F.broadcast(labelled(labels, fit_rows, label_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id")
    rows = rows.select("id", "y", _features_of(F.col("text")).alias("x")).groupBy("id", "y").agg(F.min("x").alias("x"))
    found = rows.select("y", "x", (F.pmod(F.xxhash64(F.lit("check"), "id"), F.lit(6)) == 0).alias("check"), "id").toPandas()
    found = found.sort_values("id", ignore_index=True)
    x = np.stack(found["x"].to_list()) if len(found) else np.zeros((0, len(FEATURES)))
    return fit_model(x, found["y"].to_numpy(float), found["check"].to_numpy(bool), **options)


def score_of(text: Column, model: AdditiveModel, spark) -> Column:
    """Score of a text column; the model is sent to executors once."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(features(texts.tolist())))

    return run(text.cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
                    **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; predicted is 1 from a score of ``threshold``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                         score_of(F.col(text_col), model, docs.sparkSession).alias("score"))
    return scored.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
