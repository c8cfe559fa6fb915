import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lorekeep.llm import blocks as B, suffix_dedup as S
from tests.llm.conftest import odd_rows, same


def brute(rows, length=50):
    number = lambda name: B.NO_ID if name is None else name
    first = {}
    for name, text in rows:
        data = (text or "").encode()
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            first[window] = min(first.get(window, number(name)), number(name))
    for name, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            if first[data[at : at + length]] < number(name):
                gone[at : at + length] = b"\1" * length
        spans = sum(1 for at, x in enumerate(gone) if x and (at == 0 or not gone[at - 1]))
        kept = bytes(byte for byte, x in zip(data, gone) if not x)
        yield name, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def test_hard_cases(odd):
    same(S.suffix_dedup(odd).collect(), brute([row[:2] for row in odd_rows()]))


def test_no_rows(none):
    assert S.suffix_dedup(none).collect() == []


@pytest.mark.parametrize("hot,block_bytes", [(S.HOT, 8 << 20), (2, 3000), (8, 300)])
def test_against_brute_force(spark, hot, block_bytes):
    draw = random.Random(hot)
    parts = ["".join(draw.choice("ab é") for _ in range(draw.randint(20, 150))) for _ in range(15)] + ["a" * 120, "ab" * 80]
    rows = [
        (draw.choice([None, *range(40)]), "".join(draw.choice(parts) for _ in range(draw.randint(0, 5)))[: draw.randint(0, 400)])
        for _ in range(90)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(S.suffix_dedup(docs, hot=hot, block_bytes=block_bytes).collect(), brute(rows))


def test_texts_and_spans(spark):
    passage = "".join(chr(97 + at % 23) for at in range(60))
    docs = spark.createDataFrame([(1, passage + "x"), (2, "yy" + passage)], "doc_id long, text string")
    row = S.suffix_dedup(docs, texts=True).filter("doc_id = 2").first()
    assert bytes(row.kept) == b"yy" and [list(x) for x in row.spans] == [[2, 62]]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300).map(lambda data: bytes(97 + byte % 3 for byte in data)))
def test_sync_points_are_the_leftmost_smallest_seeds(data):
    block = B.Block(np.array([1]), np.array([0, len(data)]), np.frombuffer(data, np.uint8))
    points = S.sync_points(block)
    covered = [at for first, last in zip(points.first, points.last) for at in range(first, last + 1)]
    assert covered == list(range(max(0, len(data) - S.LENGTH + 1)))
    names = {}
    for first, last, at, _, seed in zip(*points):
        for window in range(first, last + 1):
            assert window <= at <= window + S.REACH
            names.setdefault(data[window : window + S.LENGTH], set()).add(int(at - window))
    assert all(len(places) == 1 for places in names.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(0, 2), min_size=S._WORDS, max_size=S._WORDS), max_size=20), min_size=1, max_size=6))
def test_loser_tree_merges_front_coded_runs(lists):
    runs = []
    for rows in lists:
        keys = np.array(sorted(rows), np.uint64).reshape(-1, S._WORDS)
        alike = np.zeros(keys.shape, bool)
        alike[1:] = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1)
        runs.append((keys, S._Reader(alike.sum(axis=1), keys[~alike])))
    out = [(list(key), shared, run, number) for key, shared, run, number in S.merge([reader for _, reader in runs])]
    assert [key for key, *_ in out] == sorted(key for rows in lists for key in rows)
    before = None
    for key, shared, run, number in out:
        assert runs[run][0][number].tolist() == key
        if before is not None:
            assert shared == next((at for at, pair in enumerate(zip(before, key)) if pair[0] != pair[1]), S._WORDS)
        before = key
