"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The benchmark is a stated query set; it is taken in blocks of at most
   ``block_words`` words, so what is sent to the executors has a fixed size.
2. For each block, one pass over all documents counts the block's word n-grams
   in the corpus. Of every ``stride`` consecutive n-grams of an item the rarest
   becomes a seed, so any ``gram + stride - 1`` words copied unchanged hold one,
   however often the passage itself was copied into the corpus.
3. A second pass joins the documents to the items on the seeds, lays a window
   around each hit, drops windows whose common words can't reach the threshold
   (an exact bound), and aligns the rest by Smith-Waterman (match 2, mismatch -1,
   gap -1). The score is the alignment's value over that of a verbatim copy. A passage
   is a copy from a score of ``threshold``, or as an excerpt that is worth ``EXCERPT_WORDS``
   verbatim words at a density of ``EXCERPT_DENSITY``, however long the item is.

No text is shuffled and every document is judged on its own, so a passage that
sits in a third of the corpus is no hot key.

Defined results: words are ``\\w+`` runs of the lower-cased text; in scripts without
spaces each character is a word. Null or empty
texts on either side never match; items shorter than one n-gram are matched by
their whole word sequence. Repeated rows each get their own result. Of several
windows of one item the best counts, of equal ones the first. Very long texts are searched
whole, but only windows around seeds are aligned. Without documents or items nothing is found;
filters keep all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare_workers, shielded, stage, text_key

#: Scripts that are written without spaces (fixed ranges): there each character is a word.
UNSPACED = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3040-\u30ff\u3100-\u312f\u31a0-\u31bf\u31f0-\u31ff"
            "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
RUNS = re.compile(r"\w+")
WORDS = re.compile(rf"(?=\w)[{UNSPACED}]|[^\W{UNSPACED}]+")
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of a verbatim copy's score from which a passage counts as a copy.
THRESHOLD = 0.5
#: An excerpt counts as a copy too: an alignment worth so many verbatim words, at such a share of
#: the score that a verbatim copy of the passage's length would have.
EXCERPT_WORDS, EXCERPT_DENSITY = 25, 0.8


def words_of(text: str | None) -> list[str]:
    lowered = (text or "").lower()
    try:  # Latin-1 texts hold none of those scripts
        lowered.encode("latin-1")
    except UnicodeEncodeError:
        return WORDS.findall(lowered)
    return RUNS.findall(lowered)


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score, and the position in ``window`` after its last word."""
    steps = np.arange(1, len(window) + 1) * -GAP
    above, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for word in item:
        row = np.maximum(above[:-1] + np.where(window == word, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum(row, 0)
        # a gap along the window: the best earlier cell less its distance
        row = np.maximum.accumulate(row + steps) - steps
        above = np.concatenate(([0], row))
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top + 1
    return best, end


def passage(item: np.ndarray, window: np.ndarray, stop: int) -> int:
    """Words of the best alignment's passage that ends before ``stop``: it begins where the reversed one ends."""
    return smith_waterman(item[::-1], window[:stop][::-1])[1]


@dataclass
class Block:
    """Items of one block, with their words as numbers."""

    gram: int
    words: dict[str, int] = field(default_factory=dict)
    items: dict[int, np.ndarray] = field(default_factory=dict)
    grams: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)

    def add(self, number: int, text: str) -> None:
        found = words_of(text)
        if found:
            self.items[number] = np.array([self.words.setdefault(w, len(self.words)) for w in found], np.int64)

    def index(self) -> "Block":
        """n-gram length -> n-gram code -> [(item, position)]."""
        self.grams = {}
        for number, item in self.items.items():
            n = min(self.gram, len(item))
            for at, code in enumerate(self.codes(item, n)):
                self.grams.setdefault(n, {}).setdefault(int(code), []).append((number, at))
        return self

    def codes(self, ids: np.ndarray, n: int) -> np.ndarray:
        """One number for each n-gram of known words; -1 where a word is unknown."""
        size = len(ids) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64)
        code, known = np.zeros(size, np.uint64), np.ones(size, bool)
        for k in range(n):
            part = ids[k: k + size]
            code = (code * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1))
            known &= part >= 0
        return np.where(known, (code >> np.uint64(1)).astype(np.int64), -1)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(n, position, code) of the known n-grams of a document."""
        for n, table in self.grams.items():
            codes = self.codes(ids, n)
            for at in np.flatnonzero(codes >= 0):
                if (code := int(codes[at])) in table:
                    yield n, int(at), code

    def ids(self, text: str | None) -> np.ndarray:
        found = words_of(text)
        return np.fromiter(map(self.words.get, found, repeat(-1)), np.int64, len(found))

    def with_seeds(self, counts: dict[tuple[int, int], int], stride: int) -> "Block":
        """Only the rarest of every ``stride`` consecutive n-grams of an item (ties: the first)."""
        seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for number, item in self.items.items():
            n = min(self.gram, len(item))
            codes = [int(c) for c in self.codes(item, n)]
            rarity = [(counts.get((n, c), 0), i) for i, c in enumerate(codes)]
            chosen = {min(rarity[i: i + stride])[1] for i in range(max(1, len(codes) - stride + 1))}
            for at in chosen:
                seeds.setdefault(n, {}).setdefault(codes[at], []).append((number, at))
        return Block(self.gram, self.words, self.items, seeds)

    def matches(self, text: str | None, threshold: float) -> Iterator[tuple[int, float, int]]:
        """(item, score, word position after the passage) of a document's copies."""
        ids = self.ids(text)
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for n, at, code in self.hits(ids):
            for number, offset in self.grams[n][code]:
                size = len(self.items[number])
                slack = max(8, size // 4)
                start, end = max(0, at - offset - slack), min(len(ids), at - offset + size + slack)
                own = windows[number]
                if own and start <= own[-1][1]:  # hits come in order of their position for each n
                    own[-1][0], own[-1][1] = min(start, own[-1][0]), max(end, own[-1][1])
                else:
                    own.append([start, end])
        for number, own in windows.items():
            item = self.items[number]
            full, excerpt, top, place = threshold * MATCH * len(item), EXCERPT_WORDS * MATCH, 0, 0
            least = min(full, excerpt)
            for start, end in own:
                window = ids[start:end]
                if MATCH * np.isin(item, window).sum() < least:
                    continue
                score, stop = smith_waterman(item, window)
                if score > top and (score >= full or score >= excerpt and score >= EXCERPT_DENSITY * MATCH * passage(item, window, stop)):
                    top, place = score, start + stop
            if top:
                yield number, top / (MATCH * len(item)), place


def blocks_of(items: DataFrame, id_col: str, text_col: str, gram: int, block_words: int) -> Iterator[tuple[Block, dict]]:
    """The benchmark in blocks of a bounded number of words; a block comes to the driver at a time.

    Items are numbered within a block; the second value maps the number to the item's id.
    """
    items = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.where("text is not null and length(text) > 0").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (4 * block_words)))  # words are taken to have four characters on average
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    for k in range(n if total else 0):
        block, names = Block(gram), {}
        for number, row in enumerate(items.where(part == k).orderBy("id", "text").toLocalIterator()):
            block.add(number, row["text"])
            names[number] = row["id"]
        if block.items:
            yield block.index(), names


def find_copies(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_id: str = "item_id", item_text: str = "text", gram: int = 3, stride: int = 3,
                threshold: float = THRESHOLD, block_words: int = 2_000_000) -> DataFrame:
    """Pairs doc_id, key (the text's 128-bit key), item_id, score, end_word: each item found in each row."""
    spark = docs.sparkSession
    prepare_workers(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"),
                        F.col(text_col).cast("string").alias("text"))
    texts = texts.select("doc_id", F.col("key.a").alias("a"), F.col("key.b").alias("b"), "text")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, a long, b long, item_id long, score double, end_word long"
    found = None
    for block, names in blocks_of(items, item_id, item_text, gram, block_words):
        shared = spark.sparkContext.broadcast(block)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            totals: dict[tuple[int, int], int] = defaultdict(int)
            own = shared.value
            for batch in batches:
                for text in batch["text"]:
                    for n, _, code in own.hits(own.ids(text)):
                        totals[n, code] += 1
            if totals:
                yield pd.DataFrame([(n, c, x) for (n, c), x in totals.items()], columns=["n", "code", "x"])

        counts = texts.select("text").mapInPandas(count, "n int, code long, x long")
        counts = counts.groupBy("n", "code").agg(F.sum("x").alias("x"))  # a row for each n-gram of the block at most
        seeded = spark.sparkContext.broadcast(
            (block.with_seeds({(r["n"], r["code"]): r["x"] for r in counts.toLocalIterator()}, stride), names))

        def search(batches: Iterator[pd.DataFrame], seeded=seeded) -> Iterator[pd.DataFrame]:
            own, ids = seeded.value
            for batch in batches:
                rows = [(d, a, b, ids[i], score, end)
                        for d, a, b, text in zip(batch["doc_id"], batch["a"], batch["b"], batch["text"])
                        for i, score, end in own.matches(text, threshold)]
                frame = pd.DataFrame(rows, columns=["doc_id", "a", "b", "item_id", "score", "end_word"])
                frame["doc_id"] = pd.Series([r[0] for r in rows], dtype=batch["doc_id"].dtype)
                yield frame

        pairs = texts.mapInPandas(search, schema)
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return spark.createDataFrame([], f"doc_id {id_type}, key struct<a:bigint,b:bigint>, item_id long, score double, end_word long")
    return found.select("doc_id", F.struct("a", "b").alias("key"), "item_id", "score", "end_word")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` whose text holds no copy of an item. Being clean depends on the text alone."""
    gone = stage(find_copies(docs, items, id_col, text_col, **options).select("key").distinct(), "leaks")
    plain, (t,) = shielded(docs, text_col)
    marked = plain.withColumn("__x_key", text_key(F.col(t)))
    left = marked.join(gone.select(F.col("key").alias("__x_key")), "__x_key", "left_anti")
    return left.select(*plain.columns).toDF(*docs.columns)
