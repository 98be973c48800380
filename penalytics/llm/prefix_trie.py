"""Trie of the common prefixes of conversations, by vertical bitmaps.

A turn is known by a 128-bit key of its role and text, a node by the XOR of the keys of its
turns, each mixed with its position. Conversations are numbered in the order of their ids and
cut into shards of ``SHARD`` neighbours, long ones further into bands of ``BAND`` turns. A
task indexes a shard's band: (position, turn) to the bitset of the conversations that have
it. It then goes depth first: a node's bitset, intersected with the posting of one member's
next turn, is a child; what is left over gives the next child. Popcounts, the smallest member
and the list of conversations that end at a node go out for each shard and node, and
Spark adds them up by node.

Sums over subtrees need no walk: a conversation owns the nodes of which it is the smallest
member, which are the last ones of its path. Each member but a node's owner has saved the
words from that node down to where its own nodes begin, and each leaf counts for its owner.
So both sums are sums over a node's members.

The digest of a node's ends streams through the shards' lists in order. A digest of one string
is made from its beginning to its end, so one task reads a node's list, a row for each shard,
and holds a batch of it at a time.

Defined results: rows without a conversation id belong to no conversation; null roles and
texts are empty; a null turn number comes first; rows with the same number are put in order
by their keys, so a repeated row is a further turn. Texts are hashed and counted whole in the
scan, however long. Equal conversations share all their nodes. An empty table has no node,
not even a root. Only the four columns are read, so other columns' names don't matter.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penalytics.operators.ordered import rank_within

from .common import prepare_workers, stage, whole

#: Conversations of a shard, and turns of a band.
SHARD, BAND = 256, 512
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["a", "b", "depth"]
PARTIAL = ("a long, b long, depth int, up_a long, up_b long, n long, low long, words long, above long, shard long, "
           "members array<long>, ends array<long>")
EMPTY = hashlib.sha256(b"").hexdigest()


def keyed_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
                ) -> DataFrame:
    """(c, pos, a, b, w): a turn's conversation, place from 1, key and number of words."""
    role, text = whole(F.col(role_col)), whole(F.col(text_col))
    number = F.col(turn_col).cast("long")
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("c"), F.coalesce(number, F.lit(-(1 << 63))).alias("t"), number.isNotNull().alias("numbered"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), role, text).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"))
    # staged: texts are read once, and what follows moves keys only
    ranked = rank_within(stage(rows, "turn-keys"), ["c"], ["t", "numbered", "a", "b"], "place")
    return stage(ranked.select("c", (F.col("place") + 1).alias("pos"), "a", "b", "w"), "turns")


def conversations_of(keyed: DataFrame) -> DataFrame:
    """(c, n): conversations and their numbers of turns."""
    return keyed.groupBy("c").agg(F.count(F.lit(1)).alias("n"))


def lend_heads(keyed: DataFrame, block: int = 20, modulus: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations after each has taken over the first turns of its block's first conversation.

    h is the id's crc32 modulo ``modulus``: conversation c begins with the first h turns of
    c - c % block (all, if it has fewer; none, if it is absent), and its own follow from the
    one after its first h.
    """
    own = conversations_of(keyed)
    c = F.col("c")
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus))
    own = own.select("c", "n", h.alias("h"), (c - c % block).alias("base"))
    bases = own.where(c % block == 0).select(c.alias("of"), F.col("n").alias("there"))
    joined = own.join(bases, F.col("base") == F.col("of"), "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = stage(joined.select("c", "h", "base", taken.alias("taken"),
                                (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "rebuilt")
    mine = keyed.join(convs.select("c", "h", "taken"), "c").where("pos > h")
    mine = mine.select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "w")
    heads = keyed.where((c % block == 0) & (F.col("pos") < modulus)).withColumnRenamed("c", "of")
    lent = heads.join(convs.select("c", "h", "base"), F.col("of") == F.col("base")).where("pos <= h")
    return mine.unionByName(lent.select("c", "pos", "a", "b", "w")), convs.select("c", "n")


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _walk(rows: pd.DataFrame, band_turns: int) -> pd.DataFrame:
    """The nodes of one shard's band. Rows at place 0 say where a conversation enters the band:
    its prefix's key and words, and its length; the others are turns."""
    shard, band = int(rows["shard"].iloc[0]), int(rows["band"].iloc[0])
    first = band * band_turns
    ids, size, entries, turn = {}, {}, defaultdict(int), {}
    postings: dict[tuple, int] = defaultdict(int)
    for c, bit, place, a, b, w, n in zip(*(rows[x].tolist() for x in ("c", "bit", "pos", "a", "b", "w", "n"))):
        if place:
            turn[bit, place] = a, b, w
            postings[place, a, b] |= 1 << bit
        else:
            ids[bit], size[bit] = c, n
            entries[a, b, w] |= 1 << bit
    out = []

    def emit(members: int, depth: int, key: tuple, up: tuple, words: int, above: int) -> None:
        own = [ids[k] for k in _bits(members)]
        ends = [ids[k] for k in _bits(members) if size[k] == depth]
        out.append((*key, depth, *up, members.bit_count(), own[0], words, above, shard, own, ends))

    stack = [(members, first, key[:2], key[2]) for key, members in entries.items()]
    if not band:
        for members, depth, key, above in stack:
            emit(members, depth, key, (0, 0), 0, above)
    while stack:
        members, depth, key, above = stack.pop()
        if depth - first == band_turns:
            continue
        left = sum(1 << k for k in _bits(members) if size[k] > depth)
        while left:
            a, b, w = turn[(left & -left).bit_length() - 1, depth + 1]
            child = left & postings[depth + 1, a, b]
            left ^= child
            down = key[0] ^ a, key[1] ^ b
            emit(child, depth + 1, down, key, w, above)
            stack.append((child, depth + 1, down, above + w))
    return pd.DataFrame(out, columns=[c.split()[0] for c in PARTIAL.split(", ")])


def _shards(turns: DataFrame, convs: DataFrame, shard: int, band_turns: int) -> tuple[DataFrame, DataFrame]:
    """Input rows of ``_walk``, and (c, total): the words of each conversation."""
    ranked = rank_within(convs.withColumn("every", F.lit(0)), ["every"], ["c"], "rank")
    place = stage(ranked.select("c", "n", F.floor(F.col("rank") / shard).alias("shard"),
                                (F.col("rank") % shard).cast("int").alias("bit")), "places")
    band = F.floor((F.col("pos") - 1) / band_turns)
    mixed = turns.select("c", "pos", band.alias("band"), F.xxhash64("a", "b", "pos").alias("a"), F.xxhash64("b", "a", "pos").alias("b"), "w")
    mixed = stage(mixed, "mixed")
    sums = mixed.groupBy("c", "band").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("w").alias("w"))
    # a row for each band of a conversation
    so_far = Window.partitionBy("c").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    entered = sums.select("c", "band", *[f(x).over(so_far).alias(x) for f, x in ((F.bit_xor, "a"), (F.bit_xor, "b"), (F.sum, "w"))])
    entered = stage(entered.where("band > 0"), "entries")
    start = [F.lit(0).cast("long").alias(x) for x in ("band", "pos", "a", "b", "w")]
    rows = [place.select("c", "n", "shard", "bit", *start),
            entered.join(place, "c").select("c", "n", "shard", "bit", "band", F.lit(0).cast("long").alias("pos"), "a", "b", "w"),
            mixed.join(place, "c").select("c", "n", "shard", "bit", "band", "pos", "a", "b", "w")]
    total = sums.groupBy("c").agg(F.sum("w").alias("total"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]), total


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of each node's ends; rows come by node, then by shard."""
    key, state = None, None
    for batch in batches:
        done = []
        for a, b, depth, ends in zip(batch["a"], batch["b"], batch["depth"], batch["ends"]):
            if (a, b, depth) != key:
                if state:
                    done.append((*key, state.hexdigest()))
                key, state = (a, b, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ends.tolist())).encode())
        yield pd.DataFrame(done, columns=[*KEY, "sha"])
    if state:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "sha"])


def trie(turns: DataFrame, convs: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """A row for each node: node and parent (key in hex; parent of the root null), conv_id (its smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` (c, pos, a, b, w) as ``keyed_turns`` gives them, ``convs`` (c, n) with all
    conversations, those without turns too.
    """
    prepare_workers(turns.sparkSession)
    rows, total = _shards(turns, convs, shard, band)

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        return _walk(part, band)

    parts = stage(rows.groupBy("shard", "band").applyInPandas(walk, PARTIAL), "trie-shards")
    nodes = parts.groupBy(*KEY).agg(F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"),
                                    *[F.min(x).alias(x) for x in ("up_a", "up_b", "words", "above")])
    nodes = stage(nodes, "trie-merged")
    children = nodes.where("depth > 0").groupBy("up_a", "up_b", (F.col("depth") - 1).alias("up")).agg(F.count(F.lit(1)).alias("k"))
    of = lambda x: [F.col("a") == F.col(x[0]), F.col("b") == F.col(x[1]), F.col("depth") == F.col(x[2])]
    children = children.select(F.col("up_a").alias("ca"), F.col("up_b").alias("cb"), F.col("up").alias("cd"), "k")
    nodes = stage(nodes.join(children, of(("ca", "cb", "cd")), "left").select(*nodes.columns, F.coalesce("k", F.lit(0)).alias("n_children")), "trie-nodes")
    # where the conversations' own nodes begin: what they share with smaller ones, and whether they own a leaf
    owners = nodes.groupBy(F.col("conv_id").alias("owner")).agg(F.min("above").alias("own_from"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    shared = convs.join(total, "c", "left").join(owners, F.col("c") == F.col("owner"), "left").select(
        "c", F.coalesce("own_from", "total", F.lit(0)).alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    shared = stage(shared, "trie-shared")
    members = stage(parts.select(*KEY, F.explode("members").alias("c")), "trie-members")
    sums = members.join(shared, "c").groupBy(*KEY).agg(
        F.sum("shared").alias("all_shared"), F.min_by("shared", "c").alias("owners"), F.sum("leaf").alias("n_leaves"))
    ended = parts.where(F.size("ends") > 0).select(*KEY, "shard", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "shard")
    ended = ended.mapInPandas(_digests, "a long, b long, depth int, sha string")
    ended = stage(ended, "trie-ends")
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("depth").alias("pd"), F.col("conv_id").alias("parent_conv_id"))
    same = [F.col("up_a") == F.col("pa"), F.col("up_b") == F.col("pb"), F.col("depth") - 1 == F.col("pd")]
    out = nodes.join(stage(sums, "trie-sums"), KEY).join(ended, KEY, "left").join(parents, same, "left")
    name = lambda x, y: F.lower(F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0")))
    return out.select(
        name("a", "b").alias("node"), F.when(F.col("depth") > 0, name("up_a", "up_b")).alias("parent"), "conv_id", F.col("depth").cast("long").alias("depth"),
        "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("all_shared") - F.col("owners") - (F.col("n_convs") - 1) * F.col("above")).alias("saved_tokens"),
        F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, shard: int = SHARD, band: int = BAND, **columns) -> DataFrame:
    """The trie of a table of turns as they are."""
    keyed = keyed_turns(turns, **columns)
    return trie(keyed, stage(conversations_of(keyed), "conversations"), shard, band)


#: DuckDB SQL for the trie of conversations with lent heads; crc32 bit by bit.
ORACLE = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                  coalesce(role, '') AS r, coalesce(text, '') AS x
           FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY pos) AS own FROM t GROUP BY c),
k AS (SELECT c, own, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
               string_split(c::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
             lambda v, e: xor(xor(v, e) >> 1, 3988292384 * (xor(v, e) & 1))), 4294967295) % 4 AS h FROM s),
p AS (SELECT k.c, list_concat(coalesce(b.own[1:k.h], []), k.own[k.h + 1:]) AS path
      FROM k LEFT JOIN k b ON b.c = k.c - k.c % 20),
m AS (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM p),
n AS (SELECT path[1:d] AS node, d, min(c) AS conv_id, count(*) AS n_convs,
             CASE WHEN d = 0 THEN 0 ELSE any_value(len(regexp_extract_all(path[d].x, '[^\\x20\\x09-\\x0D]+'))) END AS words,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(path) = d), '')) AS ends_sha256
      FROM m GROUP BY path[1:d], d),
kids AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
q AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node, d)),
up AS (SELECT node[1:e] AS node, e AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
       FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM q) GROUP BY node[1:e], e)
SELECT q.conv_id, q.d::BIGINT AS depth, f.conv_id AS parent_conv_id, q.n_convs::BIGINT AS n_convs, q.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, q.ends_sha256
FROM q JOIN up USING (node, d) LEFT JOIN q f ON f.d = q.d - 1 AND f.node = q.node[1:q.d - 1]"""
