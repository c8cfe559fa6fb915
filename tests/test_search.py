import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import search
from lorekeep.operators.search import attach_text, render_results, search_chunks, top_groups, write_cells

QUERIES = "query_id long, embedding array<float>"
VECTORS = "question_id long, chunk_id long, embedding array<float>"


def brute(queries, vectors, k, cap=None):
    """Ranking by plain loops."""
    out = []
    for query_id, q in queries:
        q = np.array(q, dtype=np.float32).astype(float)
        scored = []
        for item, group, v in vectors:
            v = np.array(v, dtype=np.float32).astype(float)
            norm = np.linalg.norm(q) * np.linalg.norm(v)
            if norm > 0:
                scored.append((-round(float(q @ v / norm), 9) + 0.0, item, group))
        scored.sort()
        best = {}
        for far, item, group in scored[: cap or None]:
            if group not in best or (far, item) < best[group]:
                best[group] = (far, item)
        ranked = sorted((far, group, item) for group, (far, item) in best.items())[:k]
        out += [(query_id, place, group, item) for place, (_, group, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    pool = rng.standard_normal((12, 6))
    vectors = []
    for item in range(600):
        # Repeated directions make ties; chunk 0 owns a third of all vectors.
        vector = pool[item % 12] * (1 + item % 3) if item % 2 else rng.standard_normal(6)
        vectors.append((item, 0 if item % 3 == 0 else item // 7, vector.tolist()))
    vectors.append((600, 90, [0.0] * 6))
    queries = [(n, rng.standard_normal(6).tolist()) for n in range(20)]
    queries += [(20, pool[3].tolist()), (21, [0.0] * 6)]
    return queries, vectors


@pytest.fixture(scope="module")
def frames(spark, data):
    queries, vectors = data
    return spark.createDataFrame(queries, QUERIES), spark.createDataFrame(vectors, VECTORS).repartition(5)


def found(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.question_id) for r in df.collect())


@pytest.mark.parametrize("tuning", [{}, {"broadcast_queries": 5, "broadcast_vectors": 0, "cell_queries": 6, "cell_vectors": 100}, {"broadcast_queries": 5}, {"broadcast_bytes": 100}])
@pytest.mark.parametrize("k, cap", [(3, None), (3, 30), (2, 4), (100, None)])
def test_matches_brute_force(frames, data, k, cap, tuning):
    got = top_groups(*frames, group="chunk_id", item="question_id", k=k, cap=cap, **tuning)
    assert found(got) == brute(*data, k, cap)


@pytest.mark.parametrize("tuning", [{}, {"broadcast_queries": 5, "broadcast_vectors": 0, "cell_queries": 50, "cell_vectors": 100}, {"broadcast_queries": 5}])
def test_queries_from_the_searched_table(frames, data, tuning):
    _, vectors = frames
    asked = vectors.select(F.col("question_id").alias("query_id"), "embedding")
    got = top_groups(asked, vectors, group="chunk_id", item="question_id", k=2, **tuning)
    assert found(got) == brute([(item, v) for item, _, v in data[1] if any(v)], data[1], 2)


@pytest.mark.parametrize("k, cap", [(3, None), (2, 4), (100, None)])
def test_many_small_batches_per_task(spark, frames, data, k, cap):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "25")
    try:
        got = top_groups(*frames, group="chunk_id", item="question_id", k=k, cap=cap)
        assert found(got) == brute(*data, k, cap)
    finally:
        spark.conf.set(key, before)


def test_similarities_fall_and_chunks_are_distinct(frames):
    rows = search_chunks(*frames, k=5).orderBy("query_id", "rank").collect()
    by_query = {}
    for row in rows:
        by_query.setdefault(row.query_id, []).append(row)
    for hits in by_query.values():
        assert len({hit.chunk_id for hit in hits}) == len(hits) == 5
        sims = [hit.similarity for hit in hits]
        assert sims == sorted(sims, reverse=True)


def test_cap_can_lose_chunks_and_the_exact_form_does_not(spark, rows):
    vectors = [(n, 1, [1.0, 0.01 * n]) for n in range(40)] + [(50, 2, [0.0, 1.0])]
    frames = spark.createDataFrame([(1, [1.0, 0.0])], QUERIES), spark.createDataFrame(vectors, VECTORS)
    assert rows(search_chunks(*frames, k=2, cap=10), "rank", "chunk_id") == [(1, 1)]
    assert rows(search_chunks(*frames, k=2), "rank", "chunk_id") == [(1, 1), (2, 2)]


def test_empty_inputs(spark, frames):
    queries, vectors = frames
    assert search_chunks(queries, spark.createDataFrame([], VECTORS)).collect() == []
    assert search_chunks(spark.createDataFrame([], QUERIES), vectors).collect() == []
    assert search_chunks(spark.createDataFrame([], QUERIES), vectors, method="lsh").collect() == []


def test_lsh_with_every_cell_is_exact_and_has_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 32))
    data = [(n, n // 5, (centres[n % 30] + 0.3 * rng.standard_normal(32)).tolist()) for n in range(1500)]
    asked = [(n, (centres[n] + 0.3 * rng.standard_normal(32)).tolist()) for n in range(30)]
    frames = spark.createDataFrame(asked, QUERIES), spark.createDataFrame(data, VECTORS)
    exact = found(top_groups(*frames, group="chunk_id", item="question_id", k=5))
    options = dict(group="chunk_id", item="question_id", k=5, method="lsh", bits=6)
    assert found(top_groups(*frames, probes=64, **options)) == exact
    assert found(top_groups(*frames, probes=64, broadcast_queries=3, **options)) == exact
    near = found(top_groups(*frames, probes=16, **options))
    hit = {(q, c) for q, _, c, _ in near} & {(q, c) for q, _, c, _ in exact}
    assert len(hit) / len(exact) > 0.8


def test_stored_cells_are_pruned(spark, tmp_path, frames, data):
    queries, vectors = frames
    path = str(tmp_path / "cells")
    write_cells(vectors, path, bits=4)
    stored = spark.read.parquet(path)
    assert stored.count() == 600
    options = dict(group="chunk_id", item="question_id", k=3, method="lsh", bits=4)
    assert found(top_groups(queries, stored, probes=16, **options)) == brute(*data, 3)
    assert found(top_groups(queries, stored, probes=16, broadcast_queries=3, **options)) == brute(*data, 3)
    one = queries.filter("query_id = 1")
    near = top_groups(one, stored, probes=2, **options)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert found(near) == found(top_groups(one, vectors, probes=2, **options))
    with pytest.raises(Exception, match="other bits"):
        top_groups(queries, stored, probes=16, **{**options, "seed": 8}).collect()


@pytest.mark.parametrize("tuning", [{}, {"broadcast_queries": 3}, {"broadcast_queries": 3, "broadcast_vectors": 0}])
def test_every_query_is_embedded_once(spark, frames, tmp_path, tuning):
    from lorekeep.operators.models import embed

    log = str(tmp_path / "calls")

    def model(texts):
        with open(log, "a") as file:
            file.writelines(f"{text}\n" for text in texts)
        return [[float(len(text)), 1.0, 2.0, 3.0, 4.0, 5.0] for text in texts]

    asked = spark.createDataFrame([(n, "q" * n) for n in range(12)], "query_id long, text string").repartition(3)
    assert search_chunks(embed(asked, fn=model, keep=["query_id"]), frames[1], **tuning).count() > 0
    assert sorted(map(len, open(log).read().split("\n")[:-1])) == list(range(12))


def test_few_vectors_are_not_shuffled(frames):
    plan = search_chunks(*frames, broadcast_queries=5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan


def test_vectors_of_different_lengths_are_refused(spark):
    frames = spark.createDataFrame([(1, [1.0, 0.0])], QUERIES), spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0, 2.0])], VECTORS)
    with pytest.raises(Exception, match="different lengths"):
        search_chunks(*frames).collect()


def test_text_and_source(spark, rows):
    hits = spark.createDataFrame(
        [(1, 1, 10, 0.9), (1, 2, 11, 0.8), (1, 3, 12, 0.7), (1, 4, 13, 0.125)],
        "query_id long, rank int, chunk_id long, similarity double",
    )
    chunks = spark.createDataFrame([(10, "ten", "s"), (11, "", "s"), (13, "thirteen", None)], "chunk_id long, text string, source string")
    joined = attach_text(hits, chunks)
    assert rows(joined, "rank", "source", "text") == [(1, "s", "ten"), (4, "unknown", "thirteen")]
    metadata = spark.createDataFrame([(13, "other")], "chunk_id long, source string")
    assert rows(attach_text(hits, chunks, metadata), "rank", "source") == [(1, "unknown"), (4, "other")]
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert rows(render_results(joined, asked)) == [
        (1, "1. ten (relevance: 0.90)\n2. thirteen (relevance: 0.12)"),
        (2, "No relevant information found in memory"),
    ]


def test_neither_plan_makes_pairs_of_rows(frames):
    for tuning in ({}, {"broadcast_queries": 5}, {"broadcast_queries": 5, "broadcast_vectors": 0}):
        plan = search_chunks(*frames, **tuning)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "WindowGroupLimit" in plan


def test_known_floors_take_a_tile_in_single_precision():
    """With floors known a block's similarities are held a tile at a time; what single precision cannot tell apart is still ranked."""
    rng = np.random.default_rng(11)
    vectors, queries = rng.standard_normal((4096, 64)), rng.standard_normal((2000, 64))
    # Directions that differ by less than single precision holds, in every other block of rows; the later one is nearer.
    for at in range(50):
        vectors[at], vectors[4000 - at] = queries[at], queries[at]
        vectors[at, 0] += 3e-3
        vectors[4000 - at, 0] += 2.9e-3
    table = pa.table({"chunk_id": np.arange(4096), "question_id": np.arange(4096), "embedding": pa.array(list(vectors))})
    kernel = search._Kernel("chunk_id", "question_id", 1, None)
    unit = queries / np.linalg.norm(queries, axis=1)[:, None]
    exact = np.round(unit @ (vectors / np.linalg.norm(vectors, axis=1)[:, None]).T, 9) + 0.0
    best = exact.argmax(axis=1)
    assert (best[:50] == 4000 - np.arange(50)).all()
    asked, block = search._Queries(np.arange(2000), unit), kernel.hold(table)
    for floors in (exact.max(axis=1), np.sort(exact, axis=1)[:, -5], np.full(2000, 0.2), np.full(2000, -2.0)):
        hits = pa.Table.from_batches(kernel.scan(block, asked, floors.copy())).to_pydict()
        assert hits["query_id"] == list(range(2000)) and hits["chunk_id"] == best.tolist()
        assert hits["similarity"] == pytest.approx(exact.max(axis=1), abs=2e-9)
    tracemalloc.start()
    list(kernel.scan(block, asked, exact.max(axis=1)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_bounds_of_many_queries_stay_off_the_driver(spark, data, tmp_path, monkeypatch):
    """There is one a query, whatever the planner takes the size of the vectors for."""
    for name, rows, schema in (("asked", data[0], "query_id long, embedding array<float>"), ("held", data[1], "question_id long, chunk_id long, embedding array<float>")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    asked, held = (spark.read.parquet(str(tmp_path / name)) for name in ("asked", "held"))
    monkeypatch.setattr("lorekeep.operators.search.FLOOR_SHARE", 0.5)
    plans, kind, write = [], type(asked), type(asked).write

    def watched(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return write.fget(self)

    monkeypatch.setattr(kind, "write", property(watched))
    got = top_groups(asked, held, group="chunk_id", item="question_id", k=3, broadcast_queries=5, broadcast_vectors=0, cell_queries=6, cell_vectors=100)
    assert any("Join" in plan for plan in plans) and not any("Broadcast" in plan for plan in plans)
    assert found(got) == brute(*data, 3)
