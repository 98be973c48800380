"""Alignment of two tokenizers over the same texts, by as-of merges of their tokens' byte offsets.

Side A is a byte-level BPE (``tokenizers`` file) over a space and the text, side B a
SentencePiece model that adds the space itself. Token starts of a batch are offsets in the
joined bytes of its documents. ``pandas.merge_asof``, keyed by document, finds for each token
start the other side's token that covers it; the union of both directions is every pair of
overlapping tokens, and where a token starts just where the covering one does, both sides
ended together before: there one group ends and the next begins.

Links are all A-B occurrence pairs within a group. They are counted, never listed: a large
group is first summed up by id on each side. A pair's count (documents that hold it linked)
comes from blocks of documents: a task sums up the pairs of a block of ``BLOCK_BYTES`` of text,
only these sums are shuffled, and the counts come back once for each block and pair, not for
each document.

Side A is encoded by a second public library from the same file's entries where a text has
code points below ``SAME_BELOW`` only; there both libraries cut texts alike (a test tries
all of them), above it their Unicode tables may differ.

Defined results: null and empty texts, and texts that either tokenizer doesn't give back byte
by byte, have no tokens. Very long texts are a block of their own; a worker holds one text's
tokens and distinct pairs at a time. Repeated rows and null ids are documents like any other,
so they count again. Ties for an A id's highest count all count as best. Empty tables give
empty results. Of the input only the id and text columns are read, so other columns' names
don't matter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare_workers, stage

#: Text bytes that are encoded together, and text bytes and rows of a block.
CHUNK_BYTES, BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 16 << 20, 8192
#: Groups of more links than this are summed up by id before they are multiplied out.
LARGE_GROUP = 64
#: Below this code point both libraries for side A split texts alike.
SAME_BELOW = "ɐ"
#: How the byte-level file's pre-tokenizer cuts texts (fixed value of that kind of file).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BLOCK_SCHEMA = ("block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                "groups_sha256 string, pairs array<long>, times array<long>")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string")
ALIGNMENT = ("doc_id long, a_ids array<int>, b_ids array<int>, overlaps array<struct<a:int,b:int>>, "
             "groups array<struct<a_end:int,b_end:int,byte_end:long>>")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class ByteLevel:
    """Side A."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(file)
        self.library.encode_special_tokens = True
        byte = byte_of_char()
        vocabulary = self.library.get_vocab()
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.pieces[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        self.quick = self._quick(file)

    def _quick(self, file: str):
        """The other library's encoder, where ids are in the order of the merges."""
        import tiktoken
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        special = {t["id"] for t in spec.get("added_tokens", [])}
        joined = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or joined != sorted(joined) or model.get("dropout") or model.get("ignore_merges"):
            return None
        ranks = {p: i for i, p in enumerate(self.pieces) if i not in special}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        easy = [self.quick is not None and (t.isascii() or max(t) < SAME_BELOW) for t in texts]
        out: list = [self.quick.encode_to_numpy(" " + t) if e else None for t, e in zip(texts, easy)]
        for k in (k for k, e in enumerate(easy) if not e):
            out[k] = np.array(self.library.encode(" " + texts[k], add_special_tokens=False).ids, np.int64)
        return out


class Pieces:
    """Side B."""

    def __init__(self, file: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=file)
        n = self.library.get_piece_size()
        self.pieces = [bytes([int(p[1:-1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in enumerate(map(self.library.id_to_piece, range(n)))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.library.encode(texts, num_threads=1)]


@dataclass
class Alignment:
    """Tokens of both sides of a batch of documents: ids, byte starts, document, and where the groups begin."""

    docs: int
    ids: tuple[np.ndarray, np.ndarray]
    start: tuple[np.ndarray, np.ndarray]
    doc: tuple[np.ndarray, np.ndarray]

    @cached_property
    def covering(self) -> tuple[np.ndarray, np.ndarray]:
        """For each token of a side the other side's token that covers its start."""
        a, b = (pd.DataFrame({"start": s, "doc": d}) for s, d in zip(self.start, self.doc))
        find = [pd.merge_asof(x, y.assign(at=np.arange(len(y))), on="start", by="doc")["at"].to_numpy() for x, y in ((a, b), (b, a))]
        return find[0].astype(np.int64), find[1].astype(np.int64)

    @cached_property
    def group(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of each token's group: a new one begins where a token starts together with the covering one."""
        return tuple(np.cumsum(self.start[k] == self.start[1 - k][self.covering[k]]) - 1 for k in (0, 1))

    @cached_property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each group, by side."""
        return np.bincount(self.group[0]), np.bincount(self.group[1])

    @cached_property
    def group_doc(self) -> np.ndarray:
        return self.doc[0][np.flatnonzero(np.diff(self.group[0], prepend=-1))]

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of tokens with common bytes, in order: the union of both directions."""
        a, b = self.covering
        n = max(1, len(self.ids[1]))
        code = np.unique(np.concatenate((np.arange(len(a)) * n + a, b * n + np.arange(len(b)))))
        return code // n, code % n

    def group_texts(self, table: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document; table: the decimal ids with each of the separators ``,|;``."""
        (ga, gb), (na, nb) = self.group, self.sizes
        ends = np.cumsum(na), np.cumsum(nb)
        marks = np.empty(len(ga) + len(gb), np.int64)
        # A's tokens of a group stand before B's
        for k, (g, before, last) in enumerate(((ga, ends[1] - nb, ends[0]), (gb, ends[0], ends[1]))):
            sep = np.zeros(len(g), np.int64)
            sep[last - 1] = k + 1
            marks[np.arange(len(g)) + before[g]] = self.ids[k] * 3 + sep
        stops = np.cumsum(sum(np.bincount(d, minlength=self.docs) for d in self.doc))
        return [table[marks[i:j]].tobytes().translate(None, b"\0")[:-1] for i, j in zip([0, *stops], stops)]

    def links(self, width: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """doc * span + a * width + b of each document's linked id pairs in order, and how many links each has."""
        (a_ids, b_ids), (na, nb) = self.ids, self.sizes
        first = np.cumsum(na) - na, np.cumsum(nb) - nb
        count, base = na * nb, self.group_doc * span
        small = np.flatnonzero((count <= LARGE_GROUP) & (count > 1))
        one = np.flatnonzero(count == 1)
        at = np.repeat(np.arange(len(small)), count[small])
        k = np.arange(len(at)) - np.repeat(np.cumsum(count[small]) - count[small], count[small])
        g = small[at]
        i, j = np.divmod(k, nb[g])
        keys = np.concatenate((base[one] + a_ids[first[0][one]] * width + b_ids[first[1][one]],
                               base[g] + a_ids[first[0][g] + i] * width + b_ids[first[1][g] + j]))
        keys, times = np.unique(keys, return_counts=True)
        more = [(keys, times)]
        for g in np.flatnonzero(count > LARGE_GROUP):
            (ua, ca), (ub, cb) = (np.unique(ids[f[g]: f[g] + n[g]], return_counts=True) for ids, f, n in zip(self.ids, first, (na, nb)))
            more.append(((base[g] + ua[:, None] * width + ub).ravel(), (ca[:, None] * cb).ravel()))
        if len(more) > 1:
            keys, where = np.unique(np.concatenate([x for x, _ in more]), return_inverse=True)
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, where, np.concatenate([t for _, t in more]))
        return keys, times


class Aligner:
    """Both tokenizers; one for each Python worker and pair of files."""

    def __init__(self, a_file: str, b_file: str):
        self.sides = ByteLevel(a_file), Pieces(b_file)
        self.lengths = [np.array([len(p) for p in s.pieces]) for s in self.sides]
        self.width = len(self.sides[1].pieces)
        self.span = self.width * len(self.sides[0].pieces)
        top = max(len(s.pieces) for s in self.sides)
        self.table = np.array([f"{i}{s}".encode() for i in range(top) for s in ",|;"])

    def align(self, texts: list[str | None]) -> Alignment:
        """Documents that a side doesn't give back have no tokens."""
        there = [k for k, t in enumerate(texts) if t]
        found = [s.encode([texts[k] for k in there]) for s in self.sides]
        kept, at = [], 0
        empty = np.zeros(0, np.int64)
        ids, starts, docs = ([empty], [empty]), ([empty], [empty]), ([empty], [empty])
        for n, k in enumerate(there):
            whole = b" " + texts[k].encode()
            if any(b"".join(map(s.pieces.__getitem__, x[n].tolist())) != whole for s, x in zip(self.sides, found)):
                continue
            for side in (0, 1):
                own = found[side][n].astype(np.int64)
                ends = np.cumsum(self.lengths[side][own])
                ids[side].append(own)
                starts[side].append(ends - self.lengths[side][own] + at)
                docs[side].append(np.full(len(own), k))
            at += len(whole)
        join = lambda parts: tuple(map(np.concatenate, parts))
        return Alignment(len(texts), join(ids), join(starts), join(docs))


@lru_cache(maxsize=1)
def aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


def _chunks(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of up to ``CHUNK_BYTES`` characters in all, or one longer text."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and size + len(t or "") > CHUNK_BYTES:
            yield slice(first, k)
            first, size = k, 0
        size += len(t or "")
    if texts:
        yield slice(first, len(texts))


def _digest(tool: Aligner, texts: list[str | None]) -> tuple[pd.DataFrame, np.ndarray]:
    """A row for each text, and all its linked pairs, one after another."""
    x = tool.align(texts)
    keys, times = x.links(tool.width, tool.span)
    cuts = np.searchsorted(keys, np.arange(1, x.docs) * tool.span)
    pairs, counts = keys % tool.span, times.astype(np.int64)
    per_doc = [np.bincount(d, minlength=x.docs) for d in (*x.doc, x.group_doc)]
    shas = [hashlib.sha256(t).hexdigest() if t else "" for t in x.group_texts(tool.table)]
    split = np.split(counts, cuts)
    return pd.DataFrame({"n_a": per_doc[0], "n_b": per_doc[1], "n_groups": per_doc[2], "n_links": [int(t.sum()) for t in split],
                         "groups_sha256": shas, "pairs": np.split(pairs, cuts), "times": split}), pairs


def _blocks(a_file: str, b_file: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = aligner(a_file, b_file)
        block, rows, size, vocabulary = TaskContext.get().partitionId() << 32, 0, 0, []

        def close() -> pd.DataFrame:
            """The block's distinct pairs, and in how many of its documents each is linked."""
            pairs, docs = np.unique(np.concatenate(vocabulary), return_counts=True)
            return pd.DataFrame({"block": [block], "place": [-1], "doc_id": pd.array([None], "Int64"), "n_a": [0], "n_b": [0],
                                 "n_groups": [0], "n_links": [0], "groups_sha256": [""], "pairs": [pairs],
                                 "times": [docs.astype(np.int64)]})

        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            ids = batch["doc_id"].array
            for part in _chunks(texts):
                length = sum(len(t or "") for t in texts[part])
                if rows and (size + length > BLOCK_BYTES or rows >= BLOCK_ROWS):
                    yield close()
                    block, rows, size, vocabulary = block + 1, 0, 0, []
                found, pairs = _digest(tool, texts[part])
                found.insert(0, "block", block)
                found.insert(1, "place", np.arange(rows, rows + len(found)))
                found.insert(2, "doc_id", pd.array(ids[part], "Int64"))
                vocabulary.append(pairs)
                rows, size = rows + len(found), size + length
                yield found
        if rows:
            yield close()
    return run


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    prepare_workers(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def pair_counts(blocks: DataFrame, width: int) -> DataFrame:
    """(pair, n_docs, best): documents that hold a pair linked, and whether that is its A id's highest count."""
    sums = blocks.where("place = -1").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = sums.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n_docs"))
    # an A id has no more partners than side B has ids
    of_a = Window.partitionBy(F.expr(f"pair div {width}"))
    return counts.select("pair", "n_docs", (F.col("n_docs") == F.max("n_docs").over(of_a)).alias("best"))


def _with_counts(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block with the counts of their pairs summed up over their links."""
    counts = counts.sort_values("pair", ignore_index=True)
    known, n, best = (counts[c].to_numpy() for c in ("pair", "n_docs", "best"))
    at = np.cumsum([0, *map(len, docs["pairs"])])
    where = np.searchsorted(known, np.concatenate([np.zeros(0, np.int64), *docs["pairs"]]))
    times = np.concatenate([np.zeros(0, np.int64), *docs["times"]])
    sums = [np.concatenate(([0], np.cumsum(v))) for v in (times * best[where], times * n[where])] if len(where) else [np.zeros(1, np.int64)] * 2
    out = docs[["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].copy()
    out["doc_id"] = out["doc_id"].astype("Int64")
    for name, s in zip(("n_best", "count_sum"), sums):
        out[name] = s[at[1:]] - s[at[:-1]]
    return out[[c.split()[0] for c in RESULT.split(", ")]]


def align_documents(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``RESULT`` for every row: tokens, groups and links of a text, and its links' counts in the corpus."""
    found = _columns(docs, id_col, text_col).mapInPandas(_blocks(a_file, b_file), BLOCK_SCHEMA)
    blocks = stage(found, "alignment")
    counts = stage(pair_counts(blocks, Pieces(b_file).library.get_piece_size()), "pair-counts")
    wanted = blocks.where("place = -1").select(F.col("block").alias("of_block"), F.explode("pairs").alias("pair"))
    looked_up = wanted.join(counts, "pair").select("of_block", "pair", "n_docs", "best")
    rows = blocks.where("place >= 0")
    return rows.groupBy("block").cogroup(looked_up.groupBy("of_block")).applyInPandas(_with_counts, RESULT)


def link_counts(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a_id, b_id, n_docs, best) of every id pair that is linked anywhere."""
    blocks = _columns(docs, id_col, text_col).mapInPandas(_blocks(a_file, b_file), BLOCK_SCHEMA)
    width = Pieces(b_file).library.get_piece_size()
    return pair_counts(blocks, width).select(F.expr(f"cast(pair div {width} as int)").alias("a_id"),
                                             F.expr(f"cast(pair % {width} as int)").alias("b_id"), "n_docs", "best")


def alignments(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ALIGNMENT`` for every row: both id sequences, overlapping tokens by place, and where the groups end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = aligner(a_file, b_file)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for part in _chunks(texts):
                x = tool.align(texts[part])
                over = x.overlaps()
                edges = [np.searchsorted(d, np.arange(x.docs + 1)) for d in x.doc]
                last = [np.cumsum(s) for s in x.sizes]
                ends = x.start[0] + tool.lengths[0][x.ids[0]]
                rows = {"a_ids": [], "b_ids": [], "overlaps": [], "groups": []}
                cut, groups = np.searchsorted(over[0], edges[0]), np.searchsorted(x.group_doc, np.arange(x.docs + 1))
                for d in range(x.docs):
                    (a0, a1), (b0, b1), g = edges[0][d:d + 2], edges[1][d:d + 2], slice(groups[d], groups[d + 1])
                    rows["a_ids"].append(x.ids[0][a0:a1])
                    rows["b_ids"].append(x.ids[1][b0:b1])
                    pair = slice(cut[d], cut[d + 1])
                    rows["overlaps"].append([{"a": i, "b": j} for i, j in zip((over[0][pair] - a0).tolist(), (over[1][pair] - b0).tolist())])
                    from_ = x.start[0][a0] if a1 > a0 else 0
                    rows["groups"].append([{"a_end": i, "b_end": j, "byte_end": e} for i, j, e in zip(
                        (last[0][g] - a0).tolist(), (last[1][g] - b0).tolist(), (ends[last[0][g] - 1] - from_).tolist())])
                yield pd.DataFrame({"doc_id": pd.array(batch["doc_id"].array[part], "Int64"), **rows})

    return _columns(docs, id_col, text_col).mapInPandas(run, ALIGNMENT)
