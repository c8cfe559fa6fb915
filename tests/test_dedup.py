import random

from lorekeep.operators.dedup import assign_ids, dedup_chunks, first_occurrence

SCHEMA = "hash string, source string, doc_key string, pos int, text string"


def test_first_in_order_wins_even_when_one_text_is_most_of_the_input(spark, rows):
    data = [(f"h{n % 7}" if n % 3 else "hot", f"s{n % 5}", str(n), n % 4, "t") for n in range(3000)]
    random.Random(1).shuffle(data)
    expected = {}
    for row in sorted(data, key=lambda r: (r[1], r[2], r[3])):
        expected.setdefault(row[0], row)
    got = rows(first_occurrence(spark.createDataFrame(data, SCHEMA).repartition(6)))
    assert got == sorted(expected.values(), key=str)


def test_stored_chunks_are_left_out_whatever_their_status(spark, rows):
    new = spark.createDataFrame([("a", "s", "1", 0, "x"), ("b", "s", "1", 1, "y")], SCHEMA)
    stored = spark.createDataFrame([("a",)], "hash string")
    assert rows(dedup_chunks(new, stored), "hash") == [("b",)]
    assert rows(dedup_chunks(new), "hash") == [("a",), ("b",)]


def test_ids_are_dense_and_in_ingest_order(spark):
    data = [(f"h{n}", "hot" if n % 3 else f"s{n}", f"{n:05d}", 0, "t") for n in range(2000)]
    random.Random(2).shuffle(data)
    got = assign_ids(spark.createDataFrame(data, SCHEMA).repartition(8), next_id=17).collect()
    by_order = sorted(got, key=lambda r: (r.source, r.doc_key, r.pos))
    assert [row.chunk_id for row in by_order] == list(range(17, 2017))


def test_ids_of_nothing(spark):
    assert assign_ids(spark.createDataFrame([], SCHEMA)).collect() == []
