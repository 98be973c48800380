"""SentencePiece encoding and decoding by a streaming Viterbi search.

The encoder reads a text piece by piece of input and keeps only a window as long
as the longest vocabulary piece: for each boundary in it the best path that
reaches it, as a back pointer. Whenever the paths of all boundaries of the window
run through one common boundary, the ids before it are final and are given out.

Both public model kinds are decoded as their library defines them:

* unigram: the best path to a boundary has the largest sum of piece scores;
* BPE: a path is admissible if byte-pair merging would keep each of its
  neighbouring pieces apart. Merging gives every prefix exactly one result, so at
  most one path to a boundary survives, and the search finds the merge result.

Characters outside the vocabulary become byte pieces. Where no vocabulary piece
runs across a kind of boundary (before words, between letters and other characters),
all paths meet there; the ids of such a span depend on the span alone, and recent
spans are remembered (a bounded memo in each worker).

Defined results: null is encoded like an empty text, to no ids. Equal texts, in repeated
rows too, have equal ids; of equally good pieces the search keeps one order. A very long
text is encoded whole; its ids are held together. An empty table gives no rows, and only the
id and text columns are read, so other columns' names don't matter. Decoding gives
the text back byte for byte, except that U+2581, the model's own mark for a
space, comes back as a space. The model file's path is a parameter; the file is
read on the driver and sent to the executors (it has a fixed size).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare_workers

SPACE = "▁"
#: Spans that a worker remembers before it starts anew.
MEMO_SPANS = 600_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at: at + size]
            at += size


class Model:
    """Vocabulary of a SentencePiece model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.is_bpe, self.prefix, self.fallback = False, True, False
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                self.is_bpe, self.fallback = own.get(3, 1) == 2, bool(own.get(35, 0))
                if own.get(3, 1) not in (1, 2):
                    raise ValueError("only unigram and BPE models are known")
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("only models with identity normalisation that keep spaces are known")
                self.prefix = bool(own.get(3, 1))
        if USER in self.kinds:
            raise ValueError("user-defined pieces are not known")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = [0] * 256
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.bytes[int(self.pieces[i][3:5], 16)] = i
        self.longest = max(map(len, self.ids))
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - 10.0
        #: Every suffix of a piece, which a search backwards from a boundary may meet, with
        #: the piece's id where the suffix is a piece itself.
        self.endings: dict[str, int | None] = {p[i:]: None for p in self.ids for i in range(len(p))}
        self.endings.update(self.ids)
        self.span = self._span()

    def _span(self) -> re.Pattern | None:
        """Cuts marked text where no piece of the vocabulary runs across; None: nowhere.

        Looked for, from fine to coarse: cuts between letters, digits and other characters
        (and between digits), and before each word.
        """
        odd = "_" + "".join(sorted({c for p in self.ids for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
        fine = (rf"{SPACE}*[^\W\d{odd}]+", rf"{SPACE}*\d", rf"{SPACE}*(?:[^\w{SPACE}]|[{odd}])+", rf"{SPACE}+")
        for kinds in (fine, (rf"{SPACE}+[^{SPACE}]*", rf"[^{SPACE}]+")):
            span = re.compile("|".join(kinds))
            if all(span.fullmatch(p) for p in self.ids):
                return span
        return None


#: What stands for a piece in ``last``: the start of a text, and a character outside the vocabulary.
START, OTHER = -1, -2
_MISSING = object()


def extend(model: Model, joins: "Joins | None", text: str, back: list, value: list, last: list) -> None:
    """Viterbi step for every boundary of ``text`` that the three lists don't reach yet.

    ``back``: start of the best piece that ends at a boundary; ``last``: that piece's id
    (None: no path arrives); ``value``: the path's score, which only unigram models have.
    ``last[0]`` is the piece before the text.
    """
    lookup = model.endings.get
    for end in range(len(back), len(text) + 1):
        found, start_of, best = None, end - 1, 0.0
        start = end - 1
        while start >= 0:
            number = lookup(text[start:end], _MISSING)
            if number is _MISSING:
                break
            if number is not None and (left := last[start]) is not None:
                if joins is not None:
                    kept = joins.apart[number].get(left)
                    if kept is None:
                        kept = joins.stays_apart(left, number)
                    if kept:  # no other path can arrive here
                        found, start_of = number, start
                        break
                elif found is None or value[start] + model.scores[number] > best:
                    found, start_of, best = number, start, value[start] + model.scores[number]
            start -= 1
        if last[end - 1] is not None and text[end - 1] not in model.ids:  # byte pieces
            other = value[end - 1] + model.unknown_score
            if found is None or joins is None and other > best:
                found, start_of, best = OTHER, end - 1, other
        back.append(start_of)
        value.append(0.0 if joins else best)
        last.append(found)


def trace(model: Model, text: str, back: list, last: list, end: int) -> list[int]:
    """Ids of the path to the boundary ``end``."""
    found: list[int] = []
    while end > 0:
        start, number = back[end], last[end]
        if number >= 0:
            found.append(number)
        elif model.fallback:
            found += [model.bytes[b] for b in reversed(text[start:end].encode())]
        else:
            found.append(model.unknown)
        end = start
    return found[::-1]


class Encoder:
    """Search state for one text; ``feed`` and ``finish`` give ids as soon as they are final."""

    def __init__(self, model: Model, joins: "Joins | None"):
        self.model, self.joins = model, joins
        self.text = ""  # characters after the last committed boundary
        self.back, self.value, self.last = [0], [0.0], [START]

    def feed(self, chunk: str) -> Iterator[int]:
        size = 4 * self.model.longest
        for at in range(0, len(chunk), size):
            self.text += chunk[at: at + size]
            extend(self.model, self.joins, self.text, self.back, self.value, self.last)
            yield from self._commit()

    def finish(self) -> Iterator[int]:
        yield from trace(self.model, self.text, self.back, self.last, len(self.text))
        self.__init__(self.model, self.joins)

    def _commit(self) -> list[int]:
        """Give out what all boundaries still in reach have in common."""
        end = len(self.text)
        live = {b for b in range(max(0, end - self.model.longest), end + 1) if self.last[b] is not None}
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(self.back[far])
        common = live.pop()
        final = trace(self.model, self.text, self.back, self.last, common)
        if common:
            gone = self.value[common]
            self.text = self.text[common:]
            self.back = [max(0, b - common) for b in self.back[common:]]
            self.value = [v - gone for v in self.value[common:]]
            self.last = self.last[common:]
        return final


class Joins:
    """Whether byte-pair merging keeps two neighbouring pieces apart; remembers what it has seen."""

    def __init__(self, model: Model):
        self.pieces = model.pieces
        self.rank = {p: -model.scores[i] for p, i in model.ids.items()}
        self.apart: list[dict[int, bool]] = [{} for _ in model.pieces]  # by the right piece
        self.seen = 0
        self.grown: dict[str, tuple | None] = {}

    def merged(self, text: str) -> tuple[list[str], list[str], list[str]]:
        """Plain byte-pair merging (best neighbouring pair first, the leftmost of equals).

        Its result, and the first and last part at all times when they grew.
        """
        parts, rank = list(text), self.rank
        firsts, lasts = [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best = min([(rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))])
            if best[0] == np.inf:
                break
            i = best[1]
            if i == len(parts) - 2:
                lasts.append(parts[i] + parts[i + 1])
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
            if i == 0:
                firsts.append(parts[0])
        return parts, firsts, lasts

    def _growth(self, piece: str) -> tuple[list, list, bool] | None:
        """Growth of a piece's first and last part, and whether ranks only rise; None if merging doesn't make it."""
        if piece not in self.grown:
            parts, firsts, lasts = self.merged(piece)
            rises = all(self.rank[a] < self.rank[b] for grown in (firsts, lasts) for a, b in zip(grown[1:], grown[2:]))
            self.grown[piece] = (firsts, lasts, rises) if parts == [piece] else None
        return self.grown[piece]

    def _meet(self, left: str, right: str) -> bool:
        """Whether the two merge across their boundary while both grow.

        The parts at the boundary change when a side's next merge is due; a merge
        across comes first if its rank is smaller, or equal to that of the right side.
        """
        rank, never = self.rank, np.inf
        lasts, firsts = self.grown[left][1], self.grown[right][0]
        i = j = 0
        while True:
            due_left = rank[lasts[i + 1]] if i + 1 < len(lasts) else never
            due_right = rank[firsts[j + 1]] if j + 1 < len(firsts) else never
            across = rank.get(lasts[i] + firsts[j], never)
            if across < due_left and across <= due_right:
                return True
            if due_left == due_right == never:
                return False
            if due_left <= due_right:
                i += 1
            else:
                j += 1

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether the piece ``right`` may follow ``left`` (START: nothing; OTHER: never merges)."""
        self.seen += 1
        if self.seen > 500_000:  # bounds what is remembered
            self.apart, self.seen = [{} for _ in self.pieces], 0
        after = self.pieces[right]
        own = self._growth(after)
        if left >= 0:
            before = self.pieces[left]
            other = self._growth(before)
        if own is None or left >= 0 and other is None:
            kept = False
        elif left < 0:
            kept = True
        elif own[2] and other[2]:
            kept = not self._meet(before, after)
        else:
            kept = self.merged(before + after)[0] == [before, after]
        self.apart[right][left] = kept
        return kept


class Codec:
    """Encoder and decoder of one model, with a bounded memo of spans."""

    def __init__(self, data: bytes, memo_spans: int = MEMO_SPANS):
        self.model = model = Model(data)
        self.joins = Joins(model) if model.is_bpe else None
        codec = self

        class Memo(dict):
            def __missing__(self, span: str) -> bytes:
                if len(self) >= memo_spans:
                    self.clear()
                if len(span) > 64:
                    return np.array(list(codec.stream([span])), "<i4").tobytes()
                back, value, last = [0], [0.0], [START]
                extend(model, codec.joins, span, back, value, last)
                ids = trace(model, span, back, last, len(span))
                self[span] = packed = struct.pack(f"<{len(ids)}i", *ids)
                return packed

        self.memo = Memo()
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() if k == NORMAL else
                    " ⁇ ".encode() if k == UNKNOWN else b"" for p, k in zip(model.pieces, model.kinds)]

    def stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """Ids of marked text (spaces as U+2581) that comes in chunks; the window is all that is kept."""
        encoder = Encoder(self.model, self.joins)
        for chunk in chunks:
            yield from encoder.feed(chunk)
        yield from encoder.finish()

    def marked(self, text: str) -> str:
        return (SPACE if self.model.prefix else "") + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str | None) -> np.ndarray:
        marked = self.marked(text or "")
        if self.model.span is None:
            return np.array(list(self.stream([marked])), "<i4")
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.model.span.findall(marked))), "<i4")

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.model.prefix and text[:1] == " " else text


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token_ids, n_tokens, token_crc32, round_trip of every row.

    ``token_crc32`` is over the ids as little-endian 32-bit numbers; ``round_trip``
    says that decoding the ids gives the text back (U+2581 read as a space).
    """
    spark: SparkSession = docs.sparkSession
    prepare_workers(spark)
    with open(model_file, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("token_ids array<int>, n_tokens long, token_crc32 long, round_trip boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zlib
        codec = _codec(shared.value)
        for texts in batches:
            ids = [codec.encode(t) for t in texts]
            yield pd.DataFrame({
                "token_ids": pd.Series(ids, dtype=object), "n_tokens": [len(x) for x in ids],
                "token_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                "round_trip": [codec.decode(x.tolist()) == (t or "").replace(SPACE, " ") for x, t in zip(ids, texts)]})

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col).cast("string")).alias("r")).select("doc_id", "r.*")


_CODECS: dict[int, Codec] = {}


def _codec(data: bytes) -> Codec:
    """One codec for each worker and model: the memo outlives a task."""
    if (key := hash(data)) not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data)
    return _CODECS[key]
