"""The trie against plain dictionaries, for shards and bands of any size."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from penalytics.llm import prefix_trie as X

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(paths):
    """Rows of the result from {conversation: [(role, text), ...]}."""
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def subtree(node):
        yield node
        for k in kids[node]:
            yield from subtree(k)

    def saved(node):
        return (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0

    out = []
    for node, own in members.items():
        below = list(subtree(node))
        ends = ",".join(str(c) for c in own if len(paths[c]) == len(node))
        out.append((own[0], len(node), members[node[:-1]][0] if node else None, len(own), len(kids[node]),
                    sum(not kids[n] for n in below), sum(map(saved, below)), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def turns_of(rows):
    """Conversations of rows with distinct turn numbers; null ids go."""
    paths = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        paths[c].append((role or "", text or ""))
    return dict(paths)


def lent(paths):
    out = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = paths.get(c - c % 20, [])[:h] + own[h:]
    return out


def found(frame):
    names = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    made = []
    for c in rng.sample(range(400), 150):
        n = rng.choice([1, 1, 2, 3, 4, 6])
        for t in range(n):
            made.append((c, t * 3, rng.choice(["user", None]), rng.choice(["a b", "", None, "c  d\te", "long " * 9])))
    made += [(500 + i, t, "user", f"same {t}") for i in range(40) for t in range(4)]  # a large group of copies
    made += [(900, None, "system", "first"), (900, 5, "user", "x"), (None, 1, "user", "lost"), (901, 0, "user", None)]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize("shard, band", [(256, 512), (7, 2), (1, 1), (64, 3)])
def test_equals_plain_tries(spark, rows, shard, band):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(X.prefix_trie(frame, shard, band)) == plain(turns_of(rows))


def test_lent_heads(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(X.trie(*X.lend_heads(X.keyed_turns(frame)))) == plain(lent(turns_of(rows)))


def test_turnless_conversations_end_at_the_root(spark):
    # 41's first 3 turns are replaced by those of 40, which is absent: nothing is left
    c = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, t, "user", "x") for t in range(2)] + [(61, 0, "user", "y")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = found(X.trie(*X.lend_heads(X.keyed_turns(frame))))
    assert got == plain(lent(turns_of(rows)))
    assert any(r[1] == 0 and r[7] != X.EMPTY for r in got)


def test_parents_are_nodes(spark, rows):
    got = X.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    names = {r.node: r for r in got}
    assert len(names) == len(got)
    for r in got:
        if r.depth:
            assert names[r.parent].depth == r.depth - 1 and names[r.parent].conv_id == r.parent_conv_id
        else:
            assert r.parent is None


def test_ties_and_repeated_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "b"),
            (3, 0, "user", "b")]
    got = found(X.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    deepest = max(r[1] for r in got)
    assert deepest == 3 and [r[3] for r in got if r[1] == 3] == [2]  # rows in any order make one conversation


def test_one_very_long_conversation_and_text(spark):
    rows = [(1, t, "user", f"w{t % 5}") for t in range(300)] + [(2, t, "user", f"w{t % 5}") for t in range(280)] + [(3, 0, "user", "v " * 200_000)]
    got = found(X.prefix_trie(spark.createDataFrame(rows, SCHEMA), band=16))
    assert len(got) == 302
    top = next(r for r in got if r[1] == 0)
    assert top[3:7] == (3, 2, 2, 280)
    assert next(r for r in got if r[1] == 290)[3:7] == (1, 1, 1, 0)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert X.prefix_trie(empty).collect() == []
    odd = spark.createDataFrame([(1, 0, "u", "x", 5, 6)], "conv_id long, turn long, role string, text string, c long, pos long")
    assert len(X.prefix_trie(odd).collect()) == 2
