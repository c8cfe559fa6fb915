"""A trained index for approximate search: cells around centres, codes of the rest, exact ranking of the best.

Training looks at a bounded sample: ``sample_rows`` vectors at most. k-means gives the centres of the cells; what is left
of a vector behind its centre is cut into parts, and each part is named by the nearest of up to 256 entries of a
codebook, one byte a part. Every vector, not only the sample, is then put into its cell and coded. The table of the index
has the cell as its folder, so a search reads only the cells near its queries, and of these only the codes: it adds up
similarities from a table of codebook entries. Then the vectors of the best candidates are fetched and compared exactly.
Where vectors have no clusters, all cells may be asked: a search still reads a byte a part instead of the vectors.

Queries ask the cells whose centres are nearest to them. How many that takes for a given recall is measured, not
guessed: ``tuned_probes`` compares searches for a sample of the stored vectors with the exact result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from lorekeep.operators.search import RANK_DIGITS, _Queries, _fetched, _matrix, _unit_rows, _with_vector
from lorekeep.session import materialise

# Vectors that training looks at, at most.
SAMPLE_ROWS = 65_536
# Vectors per cell that the number of cells aims at, and the most cells; more vectors make larger cells.
CELL_AIM, MOST_CELLS = 64, 65_536
# Entries of a codebook: what one byte names.
ENTRIES = 256
PARTS = 16
# Candidates whose vectors are fetched, per hit that is asked for.
REFINED = 32
# Rows of a cell per file, and rows a task holds at once.
CELL_ROWS = 250_000
BLOCK_ROWS = 65_536
# Queries that are sent to every task.
BROADCAST_QUERIES, BROADCAST_BYTES = 8192, 64 << 20
# Candidates, three numbers each, that are sent to every task.
BROADCAST_CANDIDATES = 1_000_000


@dataclass(frozen=True)
class Index:
    """What training has found; small enough for every task: cells x dimensions and codebooks."""

    centres: np.ndarray  # (cells, dims), unit rows
    codebooks: np.ndarray  # (parts, entries, dims of a part)

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    @property
    def padded(self) -> int:
        return self.codebooks.shape[0] * self.codebooks.shape[2]

    def nearest(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` cells with the nearest centres, the nearest first; ties go to the smaller number."""
        n = min(n, len(self.centres))
        out = np.empty((len(unit), n), np.int64)
        for start in range(0, len(unit), 4096):
            part = slice(start, start + 4096)
            scores = np.round(unit[part] @ self.centres.T, RANK_DIGITS)
            if n == 1:
                out[part, 0] = scores.argmax(axis=1)
            else:
                out[part] = np.argsort(-scores, axis=1, kind="stable")[:, :n]
        return out

    def _parts(self, rest: np.ndarray) -> np.ndarray:
        """``(parts, rows, dims of a part)``; missing dimensions are zero."""
        filled = np.zeros((len(rest), self.padded))
        filled[:, : self.dims] = rest
        return filled.reshape(len(rest), len(self.codebooks), -1).transpose(1, 0, 2)

    def codes(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """One byte a part: the entry nearest to what is left behind the cell's centre."""
        found = np.empty((len(unit), len(self.codebooks)), np.uint8)
        for at, (part, book) in enumerate(zip(self._parts(unit - self.centres[cells]), self.codebooks)):
            found[:, at] = _closest(part, book)
        return found

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """``(rows, parts, entries)``: what each entry adds to the similarity of a query."""
        return np.einsum("prd,ped->rpe", self._parts(unit), self.codebooks)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(f"centre {at:06d}", row.tolist()) for at, row in enumerate(self.centres)]
        rows += [(f"part {at:04d}", book.ravel().tolist()) for at, book in enumerate(self.codebooks)]
        rows.append(("shape", [float(x) for x in self.codebooks.shape]))
        spark.createDataFrame(rows, "name string, numbers array<double>").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        rows = {row.name: np.array(row.numbers) for row in spark.read.parquet(path).collect()}
        shape = tuple(int(x) for x in rows.pop("shape"))
        ordered = lambda kind: np.array([rows[name] for name in sorted(rows) if name.startswith(kind)])
        return cls(ordered("centre"), ordered("part").reshape(shape))


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row by Euclidean distance; ties go to the first."""
    half = (centres**2).sum(axis=1) / 2
    out = np.empty(len(rows), np.int64)
    for start in range(0, len(rows), 8192):
        part = slice(start, start + 8192)
        out[part] = (rows[part] @ centres.T - half).argmax(axis=1)
    return out


def _clustered(rows: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 12, unit: bool = False) -> np.ndarray:
    """k-means centres; an empty cluster takes the row farthest from its centre. ``unit`` keeps centres on the sphere."""
    centres = rows[draw.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        own = _closest(rows, centres)
        counts = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts)])[filled]
        centres[filled] = np.add.reduceat(rows[order], starts, axis=0) / counts[filled, None]
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            far = ((rows - centres[own]) ** 2).sum(axis=1)
            centres[empty] = rows[np.argsort(-far, kind="stable")[: len(empty)]]
        if unit:
            norms = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(norms > 0, centres / np.where(norms > 0, norms, 1), centres)
    return centres


def train(
    vectors: DataFrame, cells: int | None = None, parts: int = PARTS, sample_rows: int = SAMPLE_ROWS, seed: int = 7
) -> Index:
    """Centres and codebooks from at most ``sample_rows`` vectors of ``vectors`` (``embedding``).

    The sample is the vectors with the smallest hashes, so it does not depend on how the table lies. ``cells`` defaults to one
    per ``CELL_AIM`` vectors of the whole table, at most a sixteenth of the sample. Vectors without direction are left out;
    without any vector there is nothing to train on (ValueError).
    """
    known = _with_vector(vectors).select("embedding")
    total = known.count()
    # Rows that repeat count once; the sort keeps no more than the sample.
    drawn = known.distinct().orderBy(F.xxhash64("embedding", F.lit(seed))).limit(sample_rows)
    table = drawn.toArrow().combine_chunks()
    if not table.num_rows:
        raise ValueError("no vectors to train on")
    rows, _ = _unit_rows(_matrix(table.column("embedding").combine_chunks()))
    if not len(rows):
        raise ValueError("no vector has a direction")
    rows = rows[np.lexsort(rows.T[::-1])]
    draw = np.random.default_rng(seed)
    wanted = cells or max(1, min(total // CELL_AIM, MOST_CELLS, len(rows) // 16))
    wanted = min(wanted, len(rows))
    centres = _clustered(rows, wanted, draw, unit=True)
    rest = rows - centres[(rows @ centres.T).argmax(axis=1)]
    parts = min(parts, rows.shape[1])
    width = -(-rows.shape[1] // parts)
    filled = np.zeros((len(rows), parts * width))
    filled[:, : rows.shape[1]] = rest
    entries = min(ENTRIES, len(rows))
    books = [_clustered(part, entries, draw) for part in filled.reshape(len(rows), parts, width).transpose(1, 0, 2)]
    return Index(centres, np.array(books))


def write_index(
    vectors: DataFrame, path: str, group: str = "chunk_id", item: str = "question_id", cells: int | None = None,
    parts: int = PARTS, sample_rows: int = SAMPLE_ROWS, seed: int = 7, file_rows: int = CELL_ROWS,
) -> Index:
    """Train on a sample, then store every vector with its cell and codes below ``path``.

    ``path/trained`` holds the centres and codebooks, ``path/vectors`` a folder per cell. A cell is spread over tasks and
    files in proportion to its rows, so one that holds much of the data is no bottleneck. Zero, non-finite and missing vectors
    have no direction and are left out, as in exact search; rows that repeat are stored as often.
    """
    index = train(vectors, cells, parts, sample_rows, seed)
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    rows = _with_vector(vectors).select(group, item, "embedding")
    schema = T.StructType([*rows.schema.fields, T.StructField("codes", T.BinaryType()), T.StructField("cell", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            unit, kept = _unit_rows(_matrix(batch.column("embedding")))
            if not len(kept):
                continue
            found = index.nearest(unit, 1)[:, 0]
            codes = index.codes(unit, found)
            columns = batch.take(pa.array(kept)).columns
            codes = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, codes, pa.array(found, pa.int32())], names=[group, item, "embedding", "codes", "cell"])

    placed = materialise(rows.mapInArrow(place, schema))
    # One row a cell: how many files it takes.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(file_rows)).alias("_files"))
    salted = placed.join(F.broadcast(sizes), "cell").withColumn("_salt", F.pmod(F.xxhash64("embedding", item), F.col("_files")))
    stored = salted.repartition("cell", "_salt").drop("_salt", "_files")
    stored.write.partitionBy("cell").option("maxRecordsPerFile", file_rows).parquet(f"{path}/vectors")
    index.save(vectors.sparkSession, f"{path}/trained")
    return index


class _Asked:
    """Queries of a task: unit vectors and what each probes."""

    def __init__(self, index: Index, queries: _Queries, probes: int, keep: int) -> None:
        self.index, self.queries, self.keep = index, queries, keep
        self.cells = index.nearest(queries.unit, probes) if len(queries.ids) else np.empty((0, 0), np.int64)

    def scan(self, table: pa.Table, cell: int, item: str) -> Iterator[pa.RecordBatch]:
        """The best rows of one cell by codes, for every query that probes it."""
        asking = np.flatnonzero((self.cells == cell).any(axis=1))
        if not len(asking) or not table.num_rows:
            return
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        names = table.column(item).combine_chunks()
        # So many queries at a time that their similarities take 32 MB.
        together = max(1, min(256, (1 << 22) // len(codes)))
        for start in range(0, len(asking), together):
            own = asking[start : start + together]
            wanted = self.queries.unit[own]
            near = np.repeat((wanted @ self.index.centres[cell])[:, None], len(codes), axis=1)
            added = self.index.tables(wanted)
            for part in range(codes.shape[1]):
                near += added[:, part, :][:, codes[:, part]]
            near = np.round(near, RANK_DIGITS)
            keep = min(self.keep, len(codes))
            picked = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
            query, row = np.repeat(np.arange(len(own)), keep), picked.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(self.queries.ids[own][query]), names.take(pa.array(row)),
                    pa.array(np.full(len(row), cell), pa.int32()), pa.array(near[query, row]),
                ],
                names=["query_id", item, "cell", "near"],
            )


def search_index(
    queries: DataFrame, path: str, index: Index, k: int, probes: int, group: str = "chunk_id", item: str = "question_id",
    candidates: int | None = None, broadcast_queries: int = BROADCAST_QUERIES, cell_queries: int = 32_768,
) -> DataFrame:
    """``query_id, rank, <group>, similarity, <item>``: about the ``k`` groups with the best vector per query.

    Only the folders of cells that some query probes are read, and in them the codes. The vectors of the ``candidates`` best rows
    of a query (``REFINED`` for each hit by default) are fetched and compared; with every cell probed and all rows candidates
    the result is exact. ``item`` names a vector. Few queries are broadcast; many meet the cells that they probe in tasks of one part
    of a cell, with queries cut by ``cell_queries``. Queries without direction have no hits.
    """
    spark = queries.sparkSession
    queries = materialise(queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding"))
    vectors = spark.read.parquet(f"{path}/vectors")
    keep = candidates or k * REFINED
    schema = T.StructType(
        [T.StructField("query_id", T.LongType()), vectors.schema[item], vectors.schema["cell"], T.StructField("near", T.DoubleType())]
    )
    head = _fetched(queries, broadcast_queries, BROADCAST_BYTES)
    if head is not None:
        asked_by = _Queries(np.empty(0, np.int64), np.empty((0, index.dims)))
        if head.num_rows:
            asked_by = _Queries.of(head.column("query_id").combine_chunks(), head.column("embedding").combine_chunks())
        asked = _Asked(index, asked_by, probes, keep)
        held = spark.sparkContext.broadcast(asked)
        # Only folders that are probed are listed by the scan.
        vectors = vectors.filter(F.col("cell").isin(np.unique(asked.cells).tolist()))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, cell in _cells(batches):
                yield from held.value.scan(table, cell, item)

        found = vectors.select(item, "codes", "cell").mapInArrow(scan, schema)
    else:
        found = _by_cell(queries, vectors, spark.sparkContext.broadcast(index), schema, probes, keep, item, cell_queries)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("near"), item)
    few = head is not None and head.num_rows * keep <= BROADCAST_CANDIDATES
    best = found.withColumn("_n", F.row_number().over(nearest)).filter(F.col("_n") <= keep).select("query_id", item, "cell").distinct()
    wanted = _with_vector(queries).select("query_id", F.col("embedding").alias("_asked"))
    fetched = vectors.select(group, item, "embedding", "cell").join(F.broadcast(best) if few else best, ["cell", item])
    fetched = fetched.join(F.broadcast(wanted) if head is not None else wanted, "query_id")
    exact = _compared(fetched.select("query_id", group, item, "embedding", "_asked"), group, item)
    best = exact.groupBy("query_id", group).agg(
        F.max("similarity").alias("similarity"), F.min(F.struct((-F.col("similarity")).alias("_far"), item))[item].alias(item)
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("similarity"), group)
    return best.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", group, "similarity", item)


def _compared(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Exact similarities of the fetched vectors with their queries."""
    schema = T.StructType([*(rows.schema[name] for name in ("query_id", group, item)), T.StructField("similarity", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = _matrix(batch.column("embedding")), _matrix(batch.column("_asked"))
            score = np.einsum("ij,ij->i", one / np.linalg.norm(one, axis=1, keepdims=True), two / np.linalg.norm(two, axis=1, keepdims=True))
            columns = [batch.column(name) for name in ("query_id", group, item)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.round(score, RANK_DIGITS) + 0.0)], names=schema.names)

    return rows.mapInArrow(compare, schema)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int]]:
    """Rows by cell, cut where the cell changes."""
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        bounds = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True]) if len(cells) else []
        for start, end in zip(bounds[:-1], bounds[1:]):
            yield pa.Table.from_batches([batch.slice(start, end - start)]), int(cells[start])


def _by_cell(queries: DataFrame, vectors: DataFrame, shared, schema, probes: int, keep: int, item: str, cell_queries: int) -> DataFrame:
    """Many queries: each goes to the cells that it probes, where parts of both sides meet."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            unit, kept = _unit_rows(_matrix(batch.column("embedding")))
            if not len(kept):
                continue
            cells = index.nearest(unit, probes)
            rows = batch.take(pa.array(np.repeat(kept, cells.shape[1])))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cells.ravel(), pa.int32())], names=["query_id", "embedding", "cell"])

    doubles = _with_vector(queries).withColumn("embedding", F.col("embedding").cast("array<double>"))
    asked = doubles.mapInArrow(probe, "query_id long, embedding array<double>, cell int")
    counts = asked.groupBy("cell").agg(F.count("*").alias("_asking")).join(vectors.groupBy("cell").agg(F.count("*").alias("_held")), "cell")
    # One row a cell, at most MOST_CELLS.
    cuts = materialise(
        counts.select("cell", F.ceil(F.col("_asking") / cell_queries).alias("_qs"), F.ceil(F.col("_held") / BLOCK_ROWS).alias("_vs"))
    )
    cut = lambda parts, *names: F.pmod(F.xxhash64(*names), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), (F.col(parts) - 1).cast("int")))
    left = asked.join(F.broadcast(cuts), "cell").select(
        "cell", "query_id", F.struct("embedding").alias("_asked"), cut("_qs", "query_id").alias("_q"), every("_vs").alias("_v")
    )
    right = vectors.select(item, "codes", "cell").join(F.broadcast(cuts), "cell")
    right = right.withColumn("_v", cut("_vs", item)).withColumn("_q", every("_qs")).drop("_qs", "_vs")

    def meet(wanted: pa.Table, held: pa.Table) -> pa.Table:
        if wanted.num_rows and held.num_rows:
            wanted = wanted.combine_chunks()
            found = _Queries.of(wanted.column("query_id").combine_chunks(), wanted.column("_asked").combine_chunks().field("embedding"))
            asked = _Asked(shared.value, found, 1, keep)
            cell = held.column("cell")[0].as_py()
            asked.cells = np.full((len(found.ids), 1), cell)
            return pa.Table.from_batches(asked.scan(held, cell, item))
        empty = [pa.array([], pa.int64()), held.column(item).slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.float64())]
        return pa.table(empty, names=["query_id", item, "cell", "near"])

    keys = ["cell", "_q", "_v"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def tuned_probes(
    queries: DataFrame, exact: DataFrame, path: str, index: Index, k: int, wanted: float = 0.95, group: str = "chunk_id",
    item: str = "question_id", most: float = 1.0,
) -> tuple[int, float]:
    """The least number of probed cells, doubling from one, whose recall reaches ``wanted``; and that recall.

    ``queries`` is a small set (``query_id, embedding``) and ``exact`` its exact hits (``query_id, <group>``); both are held against searches of
    growing width, up to the part ``most`` of all cells.
    """
    exact = materialise(exact.select("query_id", group).distinct())
    total = exact.count()
    probes, last = 1, max(1, int(len(index.centres) * most))
    while True:
        hits = search_index(queries, path, index, k, probes, group, item).select("query_id", group)
        recall = hits.join(exact, ["query_id", group]).count() / total if total else 1.0
        if recall >= wanted or probes >= last:
            return probes, recall
        probes = min(2 * probes, last)
