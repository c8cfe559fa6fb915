import math
from collections import defaultdict

import numpy as np
import pytest

from lorekeep.llm import whitening as W

ROWS = "vec_id long, embedding array<float>, label int, x string, component string, n string"


def whole(vector):
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in vector)


def expected(rows, most=16):
    """Whole numbers, exact deviations and eigenvalues in plain Python and numpy."""
    good = [(i, whole(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in good})
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    deviation = {x: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in fit}
    return good, n, sums, deviation, values, axes, np.trace(covariance)


def checked(got, rows, most=16):
    good, n, sums, deviation, values, axes, trace = expected(rows, most)
    by_id = defaultdict(list)
    for row in got:
        by_id[row.vec_id].append(row)
    copies = defaultdict(int)
    for name, _ in good:
        copies[name] += 1
    assert {name: len(found) for name, found in by_id.items()} == {name: count * len(values) for name, count in copies.items()}
    white = axes / np.sqrt(values)
    flip = {}
    for name, x in good:
        if copies[name] > 1:
            continue
        want = (np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ white)
        found = sorted(by_id[name], key=lambda row: row.component)
        assert [row.component for row in found] == list(range(1, len(values) + 1))
        for row, value, part in zip(found, want, values / trace):
            assert (row.n, row.deviation) == (n, deviation[x])
            assert row.explained == pytest.approx(part, rel=1e-9)
            if abs(value) > 1e-6:
                # Either sign, but one for all rows.
                assert flip.setdefault(row.component, np.sign(value * row.whitened)) == np.sign(value * row.whitened)
            assert abs(row.whitened) == pytest.approx(abs(value), rel=1e-6, abs=1e-8)
    assert len({row.identity_error for row in got}) == 1 and got[0].identity_error < 1e-8


@pytest.fixture
def rows():
    draw = np.random.default_rng(8)
    base = draw.standard_normal((400, 20)) @ draw.standard_normal((20, 20))
    found = [(at, [float(np.float32(c)) for c in v]) for at, v in enumerate(base)]
    found += [(1000 + at, base[7].astype(np.float32).tolist()) for at in range(200)]  # a vector with a third of all rows
    found += [(2000, None), (2001, [None] + [1.0] * 19), (2002, [float("nan")] + [1.0] * 19), (2003, [float("-inf")] * 20)]
    found += [(None, base[3].astype(np.float32).tolist()), (5, base[5].astype(np.float32).tolist())]
    return found


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", "c", "n") for i, v in rows], ROWS).repartition(3)


def test_agrees_with_numpy(spark, rows):
    checked(W.whiten(table(spark, rows)).collect(), rows)


def test_blocks_and_grid(spark, rows, monkeypatch):
    # Many small blocks, several to a task.
    monkeypatch.setattr(W, "LEAST_BLOCK", 140)
    monkeypatch.setattr(W, "MOST_BLOCK", 400)
    monkeypatch.setattr(W, "BLOCKS", 10**9)
    checked(W.whiten(table(spark, rows), 5).collect(), rows, 5)


def test_few_dimensions_and_rank(spark):
    few = [(at, [float(at), float(at % 3)]) for at in range(9)]
    checked(W.whiten(table(spark, few)).collect(), few)
    line = [(at, [float(at), 2.0 * at, 1.0]) for at in range(9)]
    got = W.whiten(table(spark, line)).collect()
    assert [row.component for row in got] == [1] * 9 and got[0].explained == pytest.approx(1)


def test_huge_entries_are_exact_or_null(spark):
    far = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [3.0, 2.0])]
    good, n, sums, deviation, *_ = expected(far)
    got = W.whiten(table(spark, far)).collect()
    limit = {i: d if (d := deviation[x]) < 1 << 63 else None for i, x in good}
    assert {row.vec_id: row.deviation for row in got} == limit and None in limit.values()
    assert W.whiten(table(spark, [(1, [3e38]), (2, [-3e38])])).count() == 2


def test_shorter_vectors_are_filled_with_zeros(spark):
    mixed = [(1, [1.0, 2.0]), (2, [5.0]), (3, []), (4, [2.0, 7.0])]
    checked(W.whiten(table(spark, mixed)).collect(), [(i, (v + [0.0, 0.0])[:2]) for i, v in mixed])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])]])
def test_without_two_vectors(spark, rows):
    got = W.whiten(table(spark, rows))
    assert got.count() == 0
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_too_many_dimensions(spark):
    with pytest.raises(ValueError, match="4096"):
        W.whiten(table(spark, [(1, [0.0] * 4097)]))
