"""Documents packed into blocks, and questions that blocks put to the whole corpus.

A block is a row of a few megabytes of texts. It sends numpy arrays, as compressed rows, to buckets by key; a
bucket sees what all blocks sent to it and answers each block in the order in which that asked. So a key that
many documents share crosses the network once per block, and a task holds one block or one
bucket, never a whole key. Buckets grow in number with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorekeep.session import scratch_path

# Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
# Bytes of text for which there is one bucket.
BUCKET_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).max
MESSAGE = "bucket long, block long, kind long, payload binary"
_MESSAGE = pa.schema([(name, pa.binary() if name == "payload" else pa.int64()) for name in ("bucket", "block", "kind", "payload")])


class Block(NamedTuple):
    ids: np.ndarray  # null ids are the largest number
    bounds: np.ndarray  # where texts begin, and the end
    data: np.ndarray  # all bytes

    def texts(self) -> Iterator[bytes]:
        whole = self.data.tobytes()
        for start, end in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            yield whole[start:end]


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each transposed bytewise, so that what changes little stands together, and compressed."""
    import zstandard

    parts = [len(arrays).to_bytes(1, "little")]
    for array in arrays:
        array = np.ascontiguousarray(array)
        turned = array.view(np.uint8).reshape(len(array), array.itemsize).T.tobytes()
        parts.append(array.dtype.str.encode().ljust(4) + len(array).to_bytes(8, "little") + turned)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueezed(payload: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(payload)
    arrays, at = [], 1
    for _ in range(data[0]):
        kind, n = np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little")
        at += 12
        turned = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        arrays.append(np.ascontiguousarray(turned.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return arrays


def packed(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block, n_bytes, ids, bounds, data`` from ``doc_id, text``, written to the shared folder and read again.

    Block numbers come from the task that packs; they are data from the time of writing on, so later reads
    agree whatever is recomputed. Null texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            bounds = np.cumsum([0, *map(len, texts)]).astype(np.int64)
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            columns = [[number], [size], [squeezed(np.array(ids, np.int64))], [squeezed(bounds)], [data]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                names=["block", "n_bytes", "ids", "bounds", "data"],
            )

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = (text.as_py() or "").encode()
                if ids and size + len(text) > block_bytes:
                    yield out()
                    ids, texts, size = [], [], 0
                    number += 1
                ids.append(NO_ID if name is None else name)
                texts.append(text)
                size += len(text)
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = scratch_path(docs.sparkSession, "blocks")
    schema = "block long, n_bytes long, ids binary, bounds binary, data binary"
    # The data are compressed already.
    rows.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def opened(row: dict) -> Block:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(row["data"])
    return Block(unsqueezed(row["ids"])[0], unsqueezed(row["bounds"])[0], np.frombuffer(data, np.uint8))


def bucket_count(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets in proportion to the bytes of all texts; one number reaches the driver."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, -(-total // bucket_bytes))


def _messages(rows: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, _MESSAGE)], schema=_MESSAGE)


def asked(blocks: DataFrame, ask: Callable[[Block], Iterator[tuple[int, bytes]]], kind: int = 0) -> DataFrame:
    """Messages of all blocks; ``ask`` gives buckets and payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _messages((bucket, row["block"], kind, load) for bucket, load in ask(opened(row)))

    return blocks.mapInArrow(run, MESSAGE)


def asked_again(
    blocks: DataFrame, replies: DataFrame, ask: Callable[[Block, dict], Iterator[tuple[int, bytes]]], kind: int
) -> DataFrame:
    """Messages of blocks that have got ``replies``: a dict of payloads by (kind, bucket)."""

    def run(block: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            found = {(x["kind"], x["bucket"]): x["payload"] for x in got.to_pylist()}
            out += [(bucket, row["block"], kind, load) for bucket, load in ask(opened(row), found)]
        return pa.Table.from_batches(_messages(iter(out)), schema=_MESSAGE)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, MESSAGE)


def answered(messages: DataFrame, answer: Callable[[list[list[np.ndarray]]], list[bytes]], kind: int) -> DataFrame:
    """Replies to messages: ``answer`` gets the arrays of all blocks of a bucket, in order of the blocks."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda row: row["block"])
        loads = answer([unsqueezed(row["payload"]) for row in rows])
        out = ((row["bucket"], row["block"], kind, load) for row, load in zip(rows, loads))
        return pa.Table.from_batches(_messages(out), schema=_MESSAGE)

    return messages.groupBy("bucket").applyInArrow(run, MESSAGE)


def finished(
    blocks: DataFrame, replies: DataFrame, finish: Callable[[Block, dict], pa.Table], schema: str
) -> DataFrame:
    """Result rows of blocks that have got ``replies``."""

    def run(block: pa.Table, got: pa.Table) -> pa.Table:
        found = {(x["kind"], x["bucket"]): x["payload"] for x in got.to_pylist()}
        return pa.concat_tables([finish(opened(row), found) for row in block.to_pylist()])

    # A block is there once; replies to blocks that are not there do not exist.
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)
