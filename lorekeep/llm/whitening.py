"""Whitening of vectors by their principal components, on MLlib's block matrices.

The distinct vectors are cut into blocks of equal height where they lie; a block that its task does not fill is
filled up with zeros after centring, which add nothing to a product. The blocks, one above the other, times their
transpose give the scatter matrix: the products of single blocks are summed by many tasks. Its eigenvectors
come from the driver, which holds one matrix of dimensions by dimensions. For the projection the
same blocks are laid out in a square, against the whitening matrix repeated down a diagonal, because MLlib deals
a product to as many tasks as its grid has sides: a single column of blocks would meet in few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, functions as F

from lorekeep.llm.blocks import squeezed, unsqueezed
from lorekeep.session import scratch_path

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
# Larger numbers count as this one, so that sums over any table stay exact.
BOUND = 1 << 50
# Longest vector: the driver holds a square matrix of that many rows.
DIMENSIONS = 4096
# Numbers in a block: as many as keep the blocks few, between these bounds.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 1 << 15, 1 << 21, 100_000
# A direction with less than this part of the largest eigenvalue is lost in the rounding of doubles.
RANK = 1e-10
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vector: str = "embedding") -> Column:
    """``floor(64 c) + 1000000`` for every entry ``c``."""
    number = lambda c: F.greatest(F.least(F.floor(F.lit(float(SCALE)) * c.cast("double")), F.lit(BOUND)), F.lit(-BOUND))
    return F.transform(vector, lambda c: number(c) + F.lit(SHIFT))


def _finite(vector: str) -> Column:
    small = lambda c: F.abs(c.cast("double")) < F.lit(float("inf"))  # false for NaN, which is the largest
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: F.coalesce(small(c), F.lit(False)))


def _matrix(data: bytes, dims: int) -> np.ndarray:
    return unsqueezed(data)[0].reshape(-1, dims)


def _cut(vectors: DataFrame, dims: int, height: int) -> DataFrame:
    """``part, place, data``: the vectors of each task in matrices of up to ``height`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def out(matrix: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "place": place, "data": squeezed(matrix.ravel())}])

        for batch in batches:
            held.append(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            rows += batch.num_rows
            if rows >= height:
                whole = np.concatenate(held)
                while len(whole) >= height:
                    yield out(whole[:height])
                    place, whole = place + 1, whole[height:]
                held, rows = [whole], len(whole)
        if rows:
            yield out(np.concatenate(held))

    return vectors.mapInArrow(run, "part long, place long, data binary")


def _sums(blocks: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Number of vectors, exact sum of each dimension, and the widest range of a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, [0] * dims, None, None
        for batch in batches:
            for data in batch.column("data").to_pylist():
                x = _matrix(data, dims)
                n += len(x)
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096].sum(axis=0)  # 4096 * 2**51 is below 2**63
                    sums = [a + b for a, b in zip(sums, part.tolist())]
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array(range(dims), pa.int32()),
                    "n": pa.array([n] * dims, pa.int64()),
                    "s": pa.array([Decimal(x) for x in sums], pa.decimal128(38, 0)),
                    "low": pa.array(low),
                    "high": pa.array(high),
                }
            )

    partial = blocks.select("data").mapInArrow(run, "dim int, n long, s decimal(38,0), low long, high long")
    found = partial.groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    rows = sorted(found.collect())  # one row a dimension
    return rows[0].n, [int(row.s) for row in rows], max(row.high - row.low for row in rows)


def _numerators(x: np.ndarray, n: int, sums: list[int], span: int) -> np.ndarray:
    """``n x - S`` exactly: in long integers where they hold the sum of squares too, else in Python's."""
    if len(sums) * (n * span) ** 2 < 1 << 62 and n * int(np.abs(x).max(initial=0)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _gram(matrix: BlockMatrix, blocks: int, together: int) -> np.ndarray:
    """The transpose times the matrix, whose blocks stand in one column; ``together`` of them meet in a task."""
    turned = matrix.transpose()._java_matrix_wrapper
    splits = max(1, -(-blocks // together))
    # The form with splits of the inner dimension; without them all blocks would meet in one task.
    product = turned.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def directions(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    kept = np.argsort(-values, kind="stable")[:most]
    kept = kept[values[kept] > max(values.max(initial=0.0), 0.0) * RANK]
    return values[kept], vectors[:, kept]


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``vectors`` (``vec_id, embedding``).

    Rows whose vector is null, or holds a null, NaN or infinite entry, are left out; the others become whole numbers
    (entries beyond 2**50 count as that). Covariances are over the distinct vectors. Rows that repeat, or share a vector,
    give their results as often; null ids are kept. ``component`` runs to ``most``, or to the number of directions in
    which the vectors differ, so that fewer than two distinct vectors give no rows, as does empty input. Shorter
    vectors count as filled up with zero entries. ``deviation`` is exact, and null if it exceeds a long. Vectors of more than 4096
    entries are refused. Other columns are left behind.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.filter(_finite("embedding")).select("vec_id", whole_numbers().alias("x"))
    total, dims, least = rows.agg(F.count("*"), F.max(F.size("x")), F.min(F.size("x"))).first()
    nothing = spark.createDataFrame([], f"vec_id {kind}, {SCHEMA}")
    if not dims:
        return nothing
    if dims > DIMENSIONS:
        raise ValueError(f"vectors of {dims} entries; {DIMENSIONS} at most")
    if least < dims:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dims) - F.size("x"))))
    height = -(-min(max(total * dims // BLOCKS, LEAST_BLOCK), MOST_BLOCK) // dims)

    path = scratch_path(spark, "whitening")
    _cut(rows.select("x").distinct(), dims, height).write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    # Numbers of blocks: those of a task follow one another, behind the blocks of the tasks before.
    counts = sorted(map(tuple, blocks.groupBy("part").count().collect()))  # one row a task
    starts, n_blocks = [], 0
    for part, count in counts:
        starts.append((part, n_blocks))
        n_blocks += count
    before = spark.createDataFrame(starts, "part long, start long")
    blocks = blocks.join(F.broadcast(before), "part").select((F.col("start") + F.col("place")).alias("b"), "data")
    n, sums, span = _sums(blocks, dims)

    def centred(data: bytes) -> DenseMatrix:
        x = _matrix(data, dims)
        filled = np.zeros((height, dims))
        filled[: len(x)] = _numerators(x, n, sums, span).astype(np.float64) / n
        return DenseMatrix(height, dims, filled.ravel(), isTransposed=True)

    together = max(1, MOST_BLOCK // (height * dims))
    stored = blocks.repartition(max(1, -(-n_blocks // together)), "b").rdd
    column = stored.map(lambda row: ((row.b, 0), centred(row.data)))
    tall = BlockMatrix(column, height, dims, n_blocks * height, dims)
    covariance = _gram(tall, n_blocks, together) / n
    values, axes = directions(covariance, most)
    if not len(values):
        return nothing
    white = axes / np.sqrt(values)
    k = len(values)

    side = math.isqrt(n_blocks - 1) + 1
    square = stored.map(lambda row: ((row.b // side, row.b % side), centred(row.data)))
    grid = BlockMatrix(square, height, dims, -(-n_blocks // side) * height, side * dims)
    diagonal = spark.sparkContext.parallelize(range(side), min(side, 64)).map(
        lambda at: ((at, at), DenseMatrix(dims, k, white.ravel(order="F")))
    )
    product = grid.multiply(BlockMatrix(diagonal, dims, k, side * dims, side * k))
    flat = product.blocks.map(lambda block: (block[0][0] * side + block[0][1], bytearray(block[1].toArray().tobytes())))
    spark.createDataFrame(flat, "b long, data binary").write.parquet(f"{path}/projected")
    projected = spark.read.parquet(f"{path}/projected")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _matrix(row["data"], dims)
                squares = (_numerators(x, n, sums, span) ** 2).sum(axis=1).tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "at": pa.array(row["b"] * height + np.arange(len(x))),
                        "_x": pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dims, x.ravel()),
                        "deviation": pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()),
                    }
                )

    def values_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                y = np.frombuffer(row["data"]).reshape(-1, k)
                yield pa.RecordBatch.from_pydict(
                    {
                        "_at": pa.array(row["b"] * height + np.arange(len(y))),
                        "y": pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * k, y.ravel()),
                    }
                )

    error = _identity_error(projected, n, k)
    fitted = blocks.mapInArrow(numbered, "at long, _x array<long>, deviation long")
    placed = rows.join(fitted, F.col("x") == F.col("_x")).select("vec_id", "at", "deviation")
    result = placed.join(projected.mapInArrow(values_of, "_at long, y array<double>"), F.col("at") == F.col("_at"))
    part = F.array(*[F.lit(float(x / np.trace(covariance))) for x in values])
    return result.select("vec_id", "deviation", F.posexplode("y").alias("_place", "whitened")).select(
        "vec_id", (F.col("_place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(part, F.col("_place") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _identity_error(projected: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the projected vectors' covariance minus the identity; rows of zeros add nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((k + 1, k))
        for batch in batches:
            for data in batch.column("data").to_pylist():
                y = np.frombuffer(data).reshape(-1, k)
                gram[:k] += y.T @ y
                gram[k] += y.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"place": pa.array(range((k + 1) * k), pa.int32()), "s": pa.array(gram.ravel())})

    sums = projected.select("data").mapInArrow(run, "place int, s double").groupBy("place").agg(F.sum("s").alias("s"))
    gram = np.zeros((k + 1) * k)
    for place, s in sums.collect():  # one row an entry of the matrix
        gram[place] = s
    gram = gram.reshape(k + 1, k) / n
    return float(np.abs(gram[:k] - np.outer(gram[k], gram[k]) - np.eye(k)).max())
