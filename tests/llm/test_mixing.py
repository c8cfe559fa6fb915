from collections import defaultdict

from pyspark.sql import functions as F

from lorekeep.llm import mixing as M
from tests.llm.conftest import odd_rows, same


def goals(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda source: (source is None, (source or "").encode()))
    weight = {source: weights[at % 3] for at, source in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [source for source in order if source not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[source] for source in free)
        over = [source for source in free if level * weight[source] > cap * sizes[source]]
        if not over:
            return fixed | {source: level * weight[source] for source in free}
        fixed |= {source: cap * sizes[source] for source in over}


def test_hard_cases(odd):
    rows = M.mix(odd).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    sizes = defaultdict(int)
    for row in odd_rows():
        sizes[row[3]] += len((row[1] or "").encode().split())
    want = goals(sizes)
    assert len(rows) == len(odd_rows())
    for row in rows:
        assert row.source_size == sizes[row.source] and abs(row.target - want[row.source]) < 1e-6
        assert row.taken == row.copies * row["size"] <= 3 * row["size"]
    same(rows, M.mix(odd.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect())


def test_no_rows(none):
    assert M.mix(none).collect() == [] and M.take(none).collect() == []


def test_takes_come_near_their_targets(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.sqrt("id") % 5).cast("int").cast("string")).alias("source"),
        (F.pmod(F.hash("id"), F.lit(400)) + 1).alias("size"),
    )
    by = M.mix(rows, block_rows=500).groupBy("source").agg(
        F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("copies").alias("copies")
    )
    for row in by.collect():
        assert abs(row.taken - row.target) < 0.03 * row.target and row.copies <= 3


def test_take_repeats_rows(spark):
    docs = spark.createDataFrame([(at, "w " * 10, "only", "x") for at in range(50)], "doc_id long, text string, source string, copy string")
    taken = M.take(docs)
    assert taken.columns == ["doc_id", "text", "source", "copy"] and taken.count() == 50
