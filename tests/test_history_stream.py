import pytest
from pyspark.sql import functions as F

from lorekeep.operators.conversations import history_window
from lorekeep.streaming.history import ROCKSDB, history_stream

SCHEMA = "conv_id long, turn long, role string, content string"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    yield
    spark.conf.set(key, before)


def test_windows_kept_over_batches_equal_those_of_the_whole_log(spark, rocksdb, tmp_path, rows):
    log = [(n % 3, n, ("user", "assistant", "tool", "system")[n % 4], f"m{n}") for n in range(40)]
    source, sink, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))

    def run(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = (
            history_stream(stream, n=5)
            .writeStream.outputMode("update")
            .option("checkpointLocation", progress)
            .foreachBatch(lambda df, number: df.withColumn("batch", F.lit(number)).write.mode("append").parquet(sink))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    run(log[:25])
    # Messages that arrive late take their place by turn.
    run(log[30:])
    run(log[25:30])
    seen = spark.read.parquet(sink)
    last = seen.groupBy("conv_id").agg(F.max("batch").alias("batch"))
    kept = seen.join(last, ["conv_id", "batch"])
    whole = history_window(spark.createDataFrame(log, SCHEMA), 5)
    columns = ("conv_id", "position", "turn", "role", "content")
    assert rows(kept, *columns) == rows(whole, *columns)


def test_messages_keep_their_other_fields(spark, rocksdb, tmp_path):
    from datetime import datetime

    from lorekeep import schemas

    call = [{"id": "c1", "type": "function", "function": {"name": "f", "arguments": "{}"}}]
    at = datetime(2024, 5, 6, 7, 8, 9, 123456)
    log = [(1, n, "tool" if n % 2 else "assistant", f"m{n}", at, None if n % 2 else call, f"c{n}" if n % 2 else None, None) for n in range(9)]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(log, schemas.MESSAGES).write.parquet(source)
    stream = spark.readStream.schema(schemas.MESSAGES).parquet(source)
    query = (
        history_stream(stream, n=4)
        .writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "progress"))
        .foreachBatch(lambda df, number: df.write.mode("append").parquet(sink))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = {r.turn: r for r in spark.read.parquet(sink).collect()}
    assert sorted(got) == [5, 6, 7, 8]
    assert got[5].tool_call_id == "c5" and got[5].tool_calls is None and got[5].ts == at
    assert got[6].tool_calls[0].function.name == "f" and got[6].tool_call_id is None


@pytest.fixture
def batches_with_data(spark):
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.mark.parametrize("idle, kept", [(0.001, [3]), (3600, [1, 2, 3])])
def test_silent_conversations_leave_the_state(spark, rocksdb, batches_with_data, tmp_path, idle, kept):
    source, sink, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    for batch, turns in enumerate(([1, 2], [3])):
        spark.createDataFrame([(1, turn, "user", f"m{turn}") for turn in turns], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = (
            history_stream(spark.readStream.schema(SCHEMA).parquet(source), n=5, idle_seconds=idle)
            .writeStream.outputMode("update")
            .option("checkpointLocation", progress)
            .foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(f"{sink}/{number}"))
            .trigger(availableNow=True)
            .start()
        )
        assert query.awaitTermination(120)
    last = spark.read.parquet(f"{sink}/1")
    assert [(row.position, row.turn) for row in last.orderBy("position").collect()] == list(enumerate(kept, 1))


def test_idle_time_is_above_zero(spark):
    with pytest.raises(ValueError):
        history_stream(spark.createDataFrame([], SCHEMA), idle_seconds=0)
