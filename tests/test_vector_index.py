"""The trained index against exact search, and searches of many queries over vectors that stay where they are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import vector_index as V
from lorekeep.operators.search import search_chunks

VECTORS = "chunk_id long, question_id string, embedding array<float>"
QUERIES = "query_id long, embedding array<float>"


def _clustered(n, dims, clusters, seed, spread=0.35):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((clusters, dims))
    rows = centres[draw.integers(0, clusters, n)] + spread * draw.standard_normal((n, dims))
    return rows.astype(np.float32)


@pytest.fixture(scope="module")
def data():
    return _clustered(4000, 32, 40, 1), _clustered(60, 32, 40, 1)


@pytest.fixture(scope="module")
def frames(spark, data):
    vectors, queries = data
    rows = [(at // 4, f"q{at:05d}", row.tolist()) for at, row in enumerate(vectors)]
    # Vectors without direction are in no cell.
    rows += [(9000, "zero", [0.0] * 32), (9001, "none", None), (9002, "nan", [float("nan")] * 32)]
    held = spark.createDataFrame(rows, VECTORS).repartition(3)
    asked = spark.createDataFrame([(at, row.tolist()) for at, row in enumerate(queries)], QUERIES)
    return held, asked


@pytest.fixture(scope="module")
def stored(frames, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    return path, V.write_index(frames[0], path, file_rows=300)


def hits(df):
    return {(row.query_id, row.chunk_id) for row in df.collect()}


def test_every_vector_is_stored_in_its_cell(spark, frames, stored, data):
    path, index = stored
    rows = spark.read.parquet(f"{path}/vectors").collect()
    assert len(rows) == 4000 and len({row.question_id for row in rows}) == 4000
    unit = data[0] / np.linalg.norm(data[0], axis=1, keepdims=True)
    own = index.nearest(unit.astype(np.float64), 1)[:, 0]
    assert all(row.cell == own[int(row.question_id[1:])] for row in rows)
    assert all(len(row.codes) == len(index.codebooks) for row in rows)


def test_codes_approximate_similarities(stored, data):
    _, index = stored
    unit = (data[0] / np.linalg.norm(data[0], axis=1, keepdims=True)).astype(np.float64)[:500]
    asked = (data[1] / np.linalg.norm(data[1], axis=1, keepdims=True)).astype(np.float64)
    cells = index.nearest(unit, 1)[:, 0]
    codes, tables = index.codes(unit, cells), index.tables(asked)
    near = asked @ index.centres[cells].T + sum(tables[:, part, :][:, codes[:, part]] for part in range(codes.shape[1]))
    assert np.abs(near - asked @ unit.T).max() < 0.25 and np.abs(near - asked @ unit.T).mean() < 0.05


def test_recall_and_share_of_the_vectors_read(frames, stored):
    path, index = stored
    exact = hits(search_chunks(frames[1], frames[0], k=3))
    found = hits(V.search_index(frames[1], path, index, 3, probes=max(1, len(index.centres) // 10)))
    assert len(found & exact) / len(exact) >= 0.9


def test_recall_without_clusters(spark, tmp_path):
    """Vectors in no order at all: all codes are read, and a twentieth of the vectors."""
    draw = np.random.default_rng(3)
    rows = draw.standard_normal((4000, 64)).astype(np.float32)
    held = spark.createDataFrame([(at, f"q{at}", row.tolist()) for at, row in enumerate(rows)], VECTORS)
    asked = spark.createDataFrame([(at, row.tolist()) for at, row in enumerate(draw.standard_normal((40, 64)).astype(np.float32))], QUERIES)
    index = V.write_index(held, str(tmp_path))
    exact = hits(search_chunks(asked, held, k=3))
    found = hits(V.search_index(asked, str(tmp_path), index, 3, probes=len(index.centres), candidates=200))
    assert len(found & exact) / len(exact) >= 0.9


def test_all_cells_and_all_candidates_are_exact(frames, stored):
    path, index = stored
    exact = search_chunks(frames[1], frames[0], k=3)
    found = V.search_index(frames[1], path, index, 3, probes=len(index.centres), candidates=10_000)
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.similarity, 7)) for r in df.collect())
    assert key(found) == key(exact)


def test_many_queries_give_the_same_hits(frames, stored):
    path, index = stored
    few = V.search_index(frames[1], path, index, 3, probes=4)
    many = V.search_index(frames[1], path, index, 3, probes=4, broadcast_queries=0, cell_queries=7)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_only_probed_folders_are_read(frames, stored):
    path, index = stored
    one = frames[1].filter("query_id = 0")
    plan = V.search_index(one, path, index, 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:200]


def test_saved_index_is_the_same(spark, stored):
    path, index = stored
    again = V.Index.load(spark, f"{path}/trained")
    assert np.array_equal(again.centres, index.centres) and np.array_equal(again.codebooks, index.codebooks)


def test_probes_are_tuned_by_recall(frames, stored):
    path, index = stored
    exact = search_chunks(frames[1], frames[0], k=3)
    probes, recall = V.tuned_probes(frames[1], exact, path, index, 3, wanted=0.9)
    assert recall >= 0.9 and probes <= len(index.centres) // 4
    assert V.tuned_probes(frames[1].limit(0), exact.limit(0), path, index, 3) == (1, 1.0)


def test_training_is_bounded_and_repeatable(frames):
    one = V.train(frames[0], cells=8, sample_rows=500)
    two = V.train(frames[0].repartition(7), cells=8, sample_rows=500)
    assert np.array_equal(one.centres, two.centres) and np.array_equal(one.codebooks, two.codebooks)
    assert one.centres.shape == (8, 32) and one.codebooks.shape == (16, 256, 2)


def test_few_and_equal_vectors(spark, tmp_path):
    rows = [(at, f"q{at}", [1.0, 0.0, 0.0]) for at in range(50)] + [(99, "other", [0.0, 1.0, 1.0])]
    held = spark.createDataFrame(rows, VECTORS)
    index = V.write_index(held, str(tmp_path))
    asked = spark.createDataFrame([(1, [1.0, 0.1, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None)], QUERIES)
    got = V.search_index(asked, str(tmp_path), index, 2, probes=len(index.centres), candidates=64)
    # Ties go to the smaller group, as in exact search.
    assert [(r.query_id, r.chunk_id) for r in got.orderBy("query_id", "rank").collect()] == [(1, 0), (1, 1)]


def test_nothing_to_train_on(spark):
    with pytest.raises(ValueError):
        V.train(spark.createDataFrame([], VECTORS))
    with pytest.raises(ValueError):
        V.train(spark.createDataFrame([(1, "a", [0.0, 0.0])], VECTORS))


@pytest.mark.parametrize("cap", [None, 4])
def test_vectors_stay_where_they_are(frames, cap):
    """Many queries over many vectors: the same hits as by a broadcast, and no shuffle below the scan."""
    few = search_chunks(frames[1], frames[0], k=3, cap=cap)
    tuning = dict(broadcast_queries=0, broadcast_vectors=0, cell_queries=9, cell_vectors=500)
    many = search_chunks(frames[1], frames[0], k=3, cap=cap, **tuning)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    stored = frames[0].filter(F.col("chunk_id") < 9000)
    plan = search_chunks(frames[1], stored, k=3, cap=cap, **tuning)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "Join" not in below and "Aggregate" not in below


def test_no_queries_or_vectors_in_the_plan_of_many(frames):
    tuning = dict(broadcast_queries=0, broadcast_vectors=0)
    assert search_chunks(frames[1].limit(0), frames[0], k=3, **tuning).collect() == []
    assert search_chunks(frames[1], frames[0].limit(0), k=3, **tuning).collect() == []
