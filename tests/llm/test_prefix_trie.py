import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lorekeep.llm import prefix_trie as P

ROWS = "conv_id long, turn long, role string, text string, n long, key string, ids string, _conv string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows):
    """All nodes in plain Python: a dictionary by sequence."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {conv: [turn for _, turn in sorted(turns)] for conv, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (abs(conv) % 100) * (1 if conv >= 0 else -1)
        built = tuple(own.get(base, [])[:h] + turns[h:])
        for depth in range(len(built) + 1):
            members[built[:depth]].append(conv)
        ends[built].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[x] for x in children[node])
    return sorted(
        (
            min(found), len(node), min(members[node[:-1]]) if node else None, len(found), len(children[node]),
            leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, found in members.items()
    )


def given(spark, rows):
    return spark.createDataFrame([(*row, 1, "k", "i", "c") for row in rows], ROWS).repartition(3)


def checked(spark, rows, *sizes):
    got = P.prefix_trie(given(spark, rows), *sizes)
    assert got.columns == COLUMNS
    # The parent of a node without a second member may be named by any sort of null.
    key = lambda row: tuple((x is not None, x or 0) if i == 2 else x for i, x in enumerate(row))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows), key=key)


def conversations(seed, n, words=3, longest=7):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        name = draw.choice((conv, conv + 1000, 100 * conv)) if conv % 7 == 0 else conv
        for turn in range(draw.randint(1, longest)):
            rows.append((name, turn, draw.choice(("user", "assistant")), "é😀x"[: draw.randint(1, words)]))
    return rows


def test_against_plain_python(spark):
    checked(spark, conversations(1, 300))


@pytest.mark.parametrize("segment, shard", [(2, 5), (3, 40), (1, 1)])
def test_segments_and_shards(spark, monkeypatch, segment, shard):
    monkeypatch.setattr(P, "PIECE", 8)
    rows = conversations(2, 120, words=2)
    # One conversation that has a third of all turns, and one beginning that very many share.
    rows += [(555, turn % 90, "user", "aé"[: turn % 2 + 1]) for turn in range(180)]
    rows += [(2000 + at, 9, "user", "again") for at in range(150)]
    checked(spark, rows, segment, shard)


def test_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 64)
    rows = [(conv, turn, "user", f"t{turn}") for conv in range(400) for turn in range(6)]
    checked(spark, rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "of no conversation"), (0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (0, 1, "system", "x" * 70000),
        (1, 5, None, "only"), (2, None, "user", "a"), (2, None, "user", "b"), (-5, 1, "user", "below"), (-100, 1, "user", "zero"),
        (99, 1, "u", "ser"), (98, 1, "us", "er"), (305, 1, "user", "without a first"), (7, 3, "user", "a\x00,b"),
    ]
    checked(spark, rows)


def test_turnless_conversations(spark):
    # Conversations that lose all their turns and have no first of their hundred.
    lost = [c for c in range(101, 400) if c % 100 and zlib.crc32(str(c).encode()) % 6 >= 2][:20]
    rows = [(c, 0, "user", "gone") for c in lost]
    checked(spark, rows)
    got = P.prefix_trie(given(spark, rows)).collect()
    assert len(got) == 1 and got[0].n_convs == 20 and got[0].n_leaves == 1


def test_no_rows(spark):
    assert P.prefix_trie(given(spark, [])).count() == 0
    assert P.prefix_trie(given(spark, [(None, 1, "user", "x")])).count() == 0


def test_trees_stay_flat():
    sequences = [{"ids": [at], "sizes": [1], "n": 1, "conv": at, "ends": None} for at in range(1023)]
    shard = P.Shard()
    root = shard.tree(sequences)

    def height(at):
        return 0 if at < 0 else 1 + max(height(shard.low[at]), height(shard.high[at]))

    assert height(shard.equal[root]) == 10
    assert [shard.number[at] for at, depth in shard.walk(root) if depth] == list(range(1023))
