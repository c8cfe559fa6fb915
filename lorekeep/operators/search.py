"""Top-k distinct groups (chunks, tools) per query by their best vector.

Similarities are computed block by block in numpy; a block of vectors gives at most ``k`` groups per
query, so the pairs never become rows. Four plans share that kernel:

* few queries: their matrix, checked to be small, is broadcast and the vectors are scanned once;
* few vectors, such as those of a tool catalog: they are broadcast and the queries are scanned once;
* many of both: vectors stay where they are, and every task goes through the queries in files, block by block;
* many of both and vectors stored by cell: queries go to the cells they probe, and only there.

A query side is materialised before its size is looked at, so that every query is embedded once.

Rankings use the similarity rounded to 9 digits, so that the order of floating-point sums cannot
decide between equal vectors; ties go to the smaller group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lorekeep import schemas
from lorekeep.operators.arrow import arrow_step
from lorekeep.session import materialise, read_shared, scratch_path

# Fixed value: the answer when there is no hit.
NOTHING_FOUND = "No relevant information found in memory"

RANK_DIGITS = 9
# Largest query set that is sent to every task: rows, and bytes as doubles.
BROADCAST_QUERIES = 8192
BROADCAST_BYTES = 64 << 20
# Largest vector side that is sent to every task that scans queries.
BROADCAST_VECTORS = 65536
# Hits that may be broadcast when they are joined: few queries times k.
BROADCAST_HITS = 100_000
# Queries of a file, and vectors held by a task, in the plans without a broadcast.
CELL_QUERIES = 32768
CELL_VECTORS = 32768
# Share of the vectors that gives the first bounds of many queries.
FLOOR_SHARE = 1 / 64
# Rows of a stored cell per file.
CELL_ROWS = 250_000
# Similarities held at once by one task; in single precision, a tile that stays in a core's cache, and its rows.
_BLOCK_CELLS = 4_000_000
_BLOCK_ROWS = 8192
_TILE_CELLS = 1 << 17
_TILE_ROWS = 512
# Pairs whose similarity is computed again at a time.
_AGAIN = 1 << 13


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a double matrix; the vectors must have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) == 0:
        return flat.reshape(0, 0)
    width, rest = divmod(len(flat), len(column))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if rest or (lengths != width).any():
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), width)


def _unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows and the numbers of the rows kept; zero and non-finite vectors have no direction."""
    norms = np.linalg.norm(matrix, axis=1)
    kept = np.flatnonzero(np.isfinite(norms) & (norms > 0))
    return matrix[kept] / norms[kept, None], kept


def _top_per_query(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k best rows of each column; ties go to the smaller row number."""
    rows = scores.shape[0]
    if rows > k:
        floor = np.partition(scores, rows - k, axis=0)[rows - k]
        query, row = np.nonzero((scores >= floor).T)
    else:
        query, row = np.nonzero(~np.isnan(scores).T)
    order = np.lexsort((row, -scores[row, query], query))
    query, row = query[order], row[order]
    first = np.searchsorted(query, query, side="left")
    kept = np.arange(len(query)) - first < k
    return query[kept], row[kept]


@dataclass(frozen=True)
class _Queries:
    ids: np.ndarray
    unit: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, vectors: pa.Array) -> _Queries:
        unit, kept = _unit_rows(_matrix(vectors))
        return cls(ids.to_numpy(zero_copy_only=False)[kept], unit)


@dataclass(frozen=True)
class _Planes:
    """Orthonormal planes whose sides give a vector its cell."""

    matrix: np.ndarray  # (dim, bits)
    probes: int

    def codes(self, unit: np.ndarray) -> np.ndarray:
        weights = 1 << np.arange(self.matrix.shape[1], dtype=np.int64)
        return (unit @ self.matrix > 0) @ weights

    def probed(self, unit: np.ndarray) -> np.ndarray:
        """Cells to look into per query: its own first, then those behind the nearest planes."""
        bits = self.matrix.shape[1]
        flips = np.arange(1 << bits, dtype=np.int64)
        members = (flips[:, None] >> np.arange(bits)) & 1
        cost = (unit @ self.matrix) ** 2 @ members.T
        nearest = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
        return self.codes(unit)[:, None] ^ flips[nearest]


def _planes(dim: int, bits: int, probes: int, seed: int) -> _Planes:
    bits = min(bits, dim)
    draw = np.random.default_rng(seed).standard_normal((dim, bits))
    return _Planes(np.linalg.qr(draw)[0], min(probes, 1 << bits))


@dataclass(frozen=True)
class _Held:
    """A block of vectors that queries are compared with, by group and item."""

    table: pa.Table
    unit: np.ndarray
    single: np.ndarray  # the same in single precision
    cells: np.ndarray | None  # as stored

    def rows(self, at: np.ndarray) -> _Held:
        return _Held(self.table.take(pa.array(at)), self.unit[at], self.single[at], None)


@dataclass(frozen=True)
class _Kernel:
    """Best candidates of one block of vectors for every query."""

    group: str
    item: str
    k: int
    cap: int | None
    planes: _Planes | None = None

    def columns(self) -> list[str]:
        return ["query_id", self.group, self.item, "similarity"]

    def start(self, queries: _Queries) -> np.ndarray:
        """Per query the similarity that a further candidate has to reach; unknown at first."""
        return np.full(len(queries.ids), -np.inf)

    def hold(self, block: pa.RecordBatch | pa.Table) -> _Held | None:
        """A block made ready for any number of scans."""
        if not block.num_rows:
            return None
        table = pa.table(block) if isinstance(block, pa.RecordBatch) else block
        table = table.combine_chunks()
        order = [(self.item, "ascending")] if self.cap else [(self.group, "ascending"), (self.item, "ascending")]
        table = table.sort_by(order).combine_chunks()
        unit, kept = _unit_rows(_matrix(table.column("embedding").combine_chunks()))
        stored = table.column("cell").take(pa.array(kept)).to_numpy() if "cell" in table.column_names else None
        table = table.select([self.group, self.item]).take(pa.array(kept))
        return _Held(table, unit, unit.astype(np.float32), stored)

    def scan(self, held: _Held | None, queries: _Queries, floors: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Candidates of a block. ``floors`` is raised by what the block holds: once ``k`` groups
        are known for a query, later blocks give only what is at least as good as the last of them.
        """
        if not len(queries.ids) or held is None:
            return
        if held.unit.shape[1] != queries.unit.shape[1]:
            raise ValueError("queries and vectors are of different lengths")
        if not len(held.unit):
            return
        if self.planes is None:
            yield from self._best(held, queries.ids, queries.unit, floors)
            return
        probed = self.planes.probed(queries.unit)
        codes = self.planes.codes(held.unit)
        if held.cells is not None and (held.cells != codes).any():
            raise ValueError("the vectors were put into cells with other bits or another seed")
        for code in np.unique(codes):
            asking = np.flatnonzero((probed == code).any(axis=1))
            if len(asking):
                inside = np.flatnonzero(codes == code)
                reached = floors[asking]
                yield from self._best(held.rows(inside), queries.ids[asking], queries.unit[asking], reached)
                floors[asking] = reached

    def _best(self, held: _Held, ids: np.ndarray, wanted: np.ndarray, floors: np.ndarray) -> Iterator[pa.RecordBatch]:
        table, unit = held.table, held.unit
        width = max(1, _BLOCK_CELLS // len(unit))
        keep = self.cap or self.k
        if self.cap:
            heads = number = np.arange(len(unit))
        else:
            groups = table.column(self.group).combine_chunks()
            codes = groups.dictionary_encode().indices.to_numpy()
            heads = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            number = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(codes)]))
        for first in range(0, len(ids), width):
            part = slice(first, first + width)
            picked = self._above(held, wanted[part], number, floors[part], keep)
            if picked is None:
                picked = self._all(unit @ wanted[part].T, number, heads, keep)
            query, row, best = picked
            found = np.bincount(query, minlength=len(ids[part]))
            full = np.flatnonzero(found >= keep)
            # Candidates come by query, the best first.
            last = best[np.cumsum(found)[full] - 1]
            floors[part][full] = np.maximum(floors[part][full], last)
            if not len(query):
                continue
            names = table.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[part][query]),
                    names.column(self.group).combine_chunks(),
                    names.column(self.item).combine_chunks(),
                    pa.array(best, pa.float64()),
                ],
                names=self.columns(),
            )

    def _all(self, scores: np.ndarray, number: np.ndarray, heads: np.ndarray, keep: int):
        """(query, row, similarity) of the best rows or groups of a block nothing is known about."""
        scores = np.round(scores, RANK_DIGITS) + 0.0
        tops = scores if self.cap else np.maximum.reduceat(scores, heads, axis=0)
        query, head = _top_per_query(tops, keep)
        best = tops[head, query]
        row = head if self.cap else self._first_best(scores, number, heads, head, query, best)
        return query, row, best

    @staticmethod
    def _above(held: _Held, wanted: np.ndarray, number: np.ndarray, floors: np.ndarray, keep: int):
        """The same from the few pairs that reach the floors; None when they are not few.

        Pairs are looked for in single precision, with room for its error, and the similarity of those found is
        computed again: no pair that reaches its floor is missed.
        """
        if not np.isfinite(floors).all():
            return None
        room = 10.0**-RANK_DIGITS
        # Products of unit vectors are off by less than their length in roundings; twice that, and some for the casts.
        least = (floors - room - (wanted.shape[1] + 4) * np.finfo(np.float32).eps).astype(np.float32)
        asked = wanted.astype(np.float32)
        rows = min(len(held.unit), _TILE_ROWS)
        width = max(1, _TILE_CELLS // rows)
        none = np.empty(0, np.int64)
        found, pairs = [(none, none, np.empty(0))], 0
        for first in range(0, len(asked), width):
            part = slice(first, first + width)
            for start in range(0, len(held.single), rows):
                tile = asked[part] @ held.single[start : start + rows].T
                hit = np.flatnonzero(tile.max(axis=1) >= least[part])
                if not len(hit):
                    continue
                query, row = np.nonzero(tile[hit] >= least[part][hit, None])
                query, row = hit[query] + first, row + start
                pairs += len(row)
                if pairs * 8 > len(held.unit) * len(wanted):
                    return None
                for at in range(0, len(row), _AGAIN):
                    asking, near = query[at : at + _AGAIN], row[at : at + _AGAIN]
                    best = np.einsum("ij,ij->i", wanted[asking], held.unit[near])
                    real = np.flatnonzero(best >= floors[asking] - room)
                    found.append((asking[real], near[real], best[real]))
        query, row, best = map(np.concatenate, zip(*found))
        best = np.round(best, RANK_DIGITS) + 0.0
        order = np.lexsort((row, -best, number[row], query))
        query, row, best = query[order], row[order], best[order]
        group = number[row]
        new = np.r_[True, (query[1:] != query[:-1]) | (group[1:] != group[:-1])][: len(row)]
        query, row, best, group = query[new], row[new], best[new], group[new]
        order = np.lexsort((group, -best, query))
        query, row, best = query[order], row[order], best[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query, side="left") < keep
        return query[kept], row[kept], best[kept]

    @staticmethod
    def _first_best(scores, number, heads, head, query, best) -> np.ndarray:
        """Row that gave each picked group its best score; the smallest item among equals."""
        tails = np.r_[heads[1:], len(number)]
        sizes = tails[head] - heads[head]
        starts = np.repeat(heads[head], sizes)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = starts + within
        hit = scores[rows, np.repeat(query, sizes)] == np.repeat(best, sizes)
        pair = np.repeat(np.arange(len(head)), sizes)[hit]
        first = np.searchsorted(pair, np.arange(len(head)), side="left")
        return rows[hit][first]


def _with_vector(df: DataFrame) -> DataFrame:
    return df.filter(F.col("embedding").isNotNull())


def _fetched(side: DataFrame, rows: int, limit_bytes: int) -> pa.Table | None:
    """A side that is small enough to broadcast; reads at most ``rows + 1`` rows of it."""
    head = _with_vector(side).limit(rows + 1).toArrow().combine_chunks()
    if head.num_rows > rows:
        return None
    vectors = head.column("embedding").combine_chunks() if head.num_rows else None
    return None if vectors is not None and len(vectors.flatten()) * 8 > limit_bytes else head


def _small_queries(queries: DataFrame, rows: int, limit_bytes: int) -> _Queries | None:
    """The query matrix when it is small enough to broadcast."""
    head = _fetched(queries, rows, limit_bytes)
    if head is None:
        return None
    if not head.num_rows:
        return _Queries(np.empty(0, np.int64), np.empty((0, 0)))
    return _Queries.of(head.column("query_id").combine_chunks(), head.column("embedding").combine_chunks())


def _scan_with_broadcast(vectors: DataFrame, kernel: _Kernel, queries: _Queries, schema) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        floors = kernel.start(queries)
        for batch in batches:
            yield from kernel.scan(kernel.hold(batch), queries, floors)

    return _with_vector(vectors).mapInArrow(run, schema)


def _scan_queries(queries: DataFrame, kernel: _Kernel, vectors: pa.Table, schema) -> DataFrame:
    """Every query against the broadcast vectors."""
    shared = vectors.schema, queries.sparkSession.sparkContext.broadcast(vectors.to_batches())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = shared
        table = pa.Table.from_batches(held.value, names)
        ready = [kernel.hold(table.slice(first, _BLOCK_ROWS)) for first in range(0, table.num_rows, _BLOCK_ROWS)]
        for batch in batches:
            wanted = _Queries.of(batch.column("query_id"), batch.column("embedding"))
            floors = kernel.start(wanted)
            for block in ready:
                yield from kernel.scan(block, wanted, floors)

    return _with_vector(queries).mapInArrow(run, schema)


def _paired(kernel: _Kernel, schema, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of every pair of a query part and a vector part, as bounded co-groups."""

    def pair(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and held.num_rows:
            asked = asked.combine_chunks()
            vectors_asked = asked.column("_asked").combine_chunks().field("embedding")
            wanted = _Queries.of(asked.column("query_id").combine_chunks(), vectors_asked)
            floors = kernel.start(wanted)
            for first in range(0, held.num_rows, _BLOCK_ROWS):
                out += kernel.scan(kernel.hold(held.slice(first, _BLOCK_ROWS)), wanted, floors)
        if out:
            return pa.Table.from_batches(out)
        empty = [pa.array([], pa.int64()), held.column(kernel.group).slice(0, 0), held.column(kernel.item).slice(0, 0)]
        return pa.table(empty + [pa.array([], pa.float64())], names=kernel.columns())

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, schema)


def _part(parts, *columns: str):
    return F.pmod(F.xxhash64(*columns), parts).cast("int")


def _every(parts):
    return F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))


def _scan_with_files(
    vectors: DataFrame, kernel: _Kernel, queries: DataFrame, schema, cell_queries: int, cell_vectors: int
) -> DataFrame:
    """Vectors stay where they are; every task reads the queries from files, block by block.

    Queries are written once, ``cell_queries`` to a file, each with the similarity that a hit has to reach: what a
    sample of the vectors gives is a lower bound. A task holds ``cell_vectors`` vectors, goes through all files, and
    remembers a number a query: what it has found raises the bound for its later vectors. So nothing is moved but the queries'
    files and the candidates, of which a task gives ``k`` a query at most for every block, and few where the bounds are tight.
    """
    asked = _with_vector(queries).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = asked.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    path = scratch_path(vectors.sparkSession, "queries")
    blocks = max(1, -(-n // cell_queries))

    def written(rows: DataFrame, name: str) -> list[str]:
        rows.write.option("maxRecordsPerFile", cell_queries).parquet(f"{path}/{name}")
        return sorted(vectors.sparkSession.read.parquet(f"{path}/{name}").inputFiles())

    bare = written(asked.withColumn("floor", F.lit(float("-inf"))).repartition(blocks), "all")
    held = _with_vector(vectors)
    drawn = held.sample(FLOOR_SHARE, seed=5)
    # The k-th best group, or the cap-th best vector, of the sample.
    sampled = _streamed(drawn, kernel, bare, schema, cell_vectors)
    if kernel.cap:
        tops = sampled.groupBy("query_id", kernel.group, kernel.item).agg(F.max("similarity").alias("similarity"))
    else:
        tops = sampled.groupBy("query_id", kernel.group).agg(F.max("similarity").alias("similarity"))
    keep = kernel.cap or kernel.k
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity")))
    floors = tops.withColumn("_n", place).filter(F.col("_n") == keep).select("query_id", F.col("similarity").alias("floor"))
    # A row per query: the planner takes it for a share of the vectors and would send it to the driver and from there to every task.
    # Dealt out by the join, the queries are not dealt again.
    bounded = asked.join(floors.hint("merge"), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    return _streamed(held, kernel, written(bounded, "bounded"), schema, cell_vectors)


def _streamed(vectors: DataFrame, kernel: _Kernel, files: list[str], schema, rows: int) -> DataFrame:
    """Candidates of every task's vectors for the queries in ``files``."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                if n + part.num_rows > rows:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield pa.Table.from_batches(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Tasks begin with different files, so that they do not all read the same one.
        first = TaskContext.get().partitionId() % len(files)
        floors: dict[str, np.ndarray] = {}
        for table in blocks(batches):
            ready = [kernel.hold(table.slice(start, _BLOCK_ROWS)) for start in range(0, table.num_rows, _BLOCK_ROWS)]
            for file in files[first:] + files[:first]:
                asked = read_shared(file)
                unit, kept = _unit_rows(_matrix(asked.column("embedding").combine_chunks()))
                wanted = _Queries(asked.column("query_id").to_numpy()[kept], unit)
                reached = floors.setdefault(file, asked.column("floor").to_numpy()[kept].copy())
                for block in ready:
                    yield from kernel.scan(block, wanted, reached)

    return vectors.mapInArrow(run, schema)


def _scan_probed_cells(
    vectors: DataFrame, kernel: _Kernel, queries: DataFrame, schema, cell_queries: int, cell_vectors: int
) -> DataFrame:
    """Queries meet vectors in the cells that they probe, by an equi-join on the cell.

    A cell is cut into as many parts as its rows on either side call for, so a cell with much of the data
    is spread over many tasks. Vectors in cells that no query probes are not moved.
    """
    planes = kernel.planes

    def probe(column: pa.Array) -> list[pa.Array]:
        matrix = _matrix(column)
        unit, kept = _unit_rows(matrix)
        cells: list = [None] * len(matrix)
        for row, probed in zip(kept, planes.probed(unit) if len(kept) else []):
            cells[row] = probed
        return [pa.array(cells, pa.list_(pa.int32()))]

    added = T.StructType([T.StructField("_cells", T.ArrayType(T.IntegerType()))])
    asked = arrow_step(_with_vector(queries), {"embedding": F.col("embedding")}, added, probe)
    asked = asked.select("query_id", F.struct("embedding").alias("_asked"), F.explode("_cells").alias("cell"))
    counts = asked.groupBy("cell").agg(F.count("*").alias("_asking")).join(
        vectors.groupBy("cell").agg(F.count("*").alias("_held")), "cell"
    )
    # One row per cell, and cells are a power of two that the caller chose.
    parts = materialise(
        counts.select(
            "cell",
            F.ceil(F.col("_asking") / F.lit(cell_queries)).alias("_qs"),
            F.ceil(F.col("_held") / F.lit(cell_vectors)).alias("_vs"),
        )
    )
    left = asked.join(parts, "cell").select(
        "cell", "query_id", "_asked", _part(F.col("_qs"), "query_id").alias("_q"), _every(F.col("_vs")).alias("_v")
    )
    right = _with_vector(vectors).join(parts, "cell").withColumn("_v", _part(F.col("_vs"), kernel.group, kernel.item))
    right = right.withColumn("_q", _every(F.col("_qs"))).drop("_qs", "_vs")
    return _paired(kernel, schema, left, right, ["cell", "_q", "_v"])


def top_groups(
    queries: DataFrame,
    vectors: DataFrame,
    group: str,
    item: str,
    k: int,
    cap: int | None = None,
    method: str = "exact",
    bits: int = 8,
    probes: int = 32,
    seed: int = 7,
    with_item: bool = True,
    broadcast_queries: int = BROADCAST_QUERIES,
    broadcast_bytes: int = BROADCAST_BYTES,
    broadcast_vectors: int = BROADCAST_VECTORS,
    cell_queries: int = CELL_QUERIES,
    cell_vectors: int = CELL_VECTORS,
) -> DataFrame:
    """``query_id, rank, <group>, similarity, <item>``: the k groups with the best vector per query.

    ``cap`` keeps only that many best vectors per query before groups are formed, as a store that
    over-fetches does; it can return fewer than ``k`` groups. Without it the result is exact.
    ``method="lsh"`` compares a query only with vectors in the cells nearest to it, and re-ranks
    those exactly; with every cell probed it equals the exact result. Vectors with a ``cell`` column,
    read from what ``write_cells`` stored, are scanned in the probed cells only.

    The item of the best vector is part of the result ``with_item``.
    """
    if method not in ("exact", "lsh"):
        raise ValueError("method is 'exact' or 'lsh'")
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    in_cells = method == "lsh" and "cell" in vectors.columns
    vectors = vectors.select(group, item, "embedding", *(["cell"] if in_cells else []))
    schema = T.StructType(
        [
            T.StructField("query_id", T.LongType()),
            vectors.schema[group],
            vectors.schema[item],
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    # Looked at and then used: without this, a model behind the queries would run for each.
    queries = materialise(queries)
    small = _small_queries(queries, broadcast_queries, broadcast_bytes)
    planes = None
    if method == "lsh":
        dim = small.unit.shape[1] if small is not None else _with_vector(queries).select(F.size("embedding")).first()[0]
        planes = _planes(dim, bits, probes, seed)
        if in_cells and small is not None and len(small.ids):
            # A stored table of cells is read only where a query looks.
            vectors = vectors.filter(F.col("cell").isin(np.unique(planes.probed(small.unit)).tolist()))
    kernel = _Kernel(group, item, k, cap, planes)
    if small is not None:
        found = _scan_with_broadcast(vectors, kernel, small, schema)
    elif in_cells:
        found = _scan_probed_cells(vectors, kernel, queries, schema, cell_queries, cell_vectors)
    elif (held := _fetched(vectors, broadcast_vectors, broadcast_bytes)) is not None:
        found = _scan_queries(queries, kernel, held, schema)
    else:
        found = _scan_with_files(vectors, kernel, queries, schema, cell_queries, cell_vectors)
    if cap:
        nearest = Window.partitionBy("query_id").orderBy(F.desc("similarity"), item)
        found = found.withColumn("_n", F.row_number().over(nearest)).filter(F.col("_n") <= cap)
    best = [F.max("similarity").alias("similarity")]
    if with_item:
        # The smallest (-similarity, item) is the best vector, with ties to the smaller item.
        best.append(F.min(F.struct((-F.col("similarity")).alias("_far"), item))[item].alias(item))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("similarity"), group)
    hits = (
        found.groupBy("query_id", group)
        .agg(*best)
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", group, "similarity", *([item] if with_item else []))
    )
    # The number of hits is bounded by the queries counted above: joins may broadcast them instead of
    # moving a table of texts.
    few = small is not None and len(small.ids) * k <= BROADCAST_HITS
    return F.broadcast(hits) if few else hits


def write_cells(
    vectors: DataFrame, path: str, bits: int = 8, seed: int = 7, file_rows: int = CELL_ROWS, mode: str = "overwrite"
) -> None:
    """Store vectors with their ``cell``, a folder per cell, for ``method="lsh"``.

    Zero and missing vectors have no direction and are left out. A cell is spread over tasks in
    proportion to its rows, so that one with much of the data is no bottleneck and files stay of one size.
    """

    def compute(column: pa.Array) -> list[pa.Array]:
        matrix = _matrix(column)
        cells = np.full(len(matrix), -1)
        unit, kept = _unit_rows(matrix)
        if len(kept):
            cells[kept] = _planes(matrix.shape[1], bits, 1, seed).codes(unit)
        return [pa.array(cells, pa.int32())]

    added = T.StructType([T.StructField("cell", T.IntegerType())])
    placed = arrow_step(_with_vector(vectors), {"embedding": F.col("embedding")}, added, compute)
    placed = placed.filter(F.col("cell") >= 0)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(file_rows)).alias("_files"))
    rows = placed.join(sizes, "cell").withColumn("_salt", F.pmod(F.xxhash64("embedding"), F.col("_files")))
    rows = rows.repartition("cell", "_salt").drop("_salt", "_files")
    rows.write.mode(mode).partitionBy("cell").option("maxRecordsPerFile", file_rows).parquet(path)


def search_chunks(
    queries: DataFrame,
    questions: DataFrame,
    k: int = schemas.TOP_CHUNKS,
    cap: int | None = None,
    method: str = "exact",
    **tuning,
) -> DataFrame:
    """Top-k distinct chunks per query: ``query_id, rank, chunk_id, similarity``.

    ``cap`` is the number of vectors per chunk assumed by an over-fetching store (10 there);
    the default searches without a cap.
    """
    return top_groups(
        queries,
        questions,
        group="chunk_id",
        item="question_id",
        k=k,
        cap=k * cap if cap else None,
        method=method,
        with_item=False,
        **tuning,
    )


def attach_text(hits: DataFrame, payload: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Hits with their chunk's text and source; hits without text are dropped.

    ``payload`` holds ``chunk_id, text``; sources come from ``metadata`` when given, else from
    ``payload``, and default to ``unknown``.
    """
    keys = [name for name in hits.columns if name not in ("source", "text")]
    texts = payload.filter(F.col("text") != "")
    if metadata is None:
        found = hits.select(keys).join(texts.select("chunk_id", "text", "source"), "chunk_id")
    else:
        # Texts and sources as one table, so that the hits, and the search behind them, are joined once.
        empty = F.lit(None).cast("string")
        both = texts.select("chunk_id", "text", empty.alias("source")).unionByName(
            metadata.select("chunk_id", empty.alias("text"), "source")
        )
        found = (
            hits.select(keys)
            .join(both, "chunk_id")
            .groupBy(*keys)
            .agg(F.max("text").alias("text"), F.max("source").alias("source"))
            .filter(F.col("text").isNotNull())
        )
    return found.select(*keys, F.coalesce("source", F.lit("unknown")).alias("source"), "text")


def render_results(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, answer``: the numbered hits of each query, or a fixed sentence without hits."""
    line = F.format_string(
        "%d. %s (relevance: %.2f)", F.col("place"), F.col("text"), F.bround("similarity", 2)
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    lines = hits.withColumn("place", place).select("query_id", "place", line.alias("line"))
    # At most k lines per query.
    listed = lines.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("place", "line"))), lambda entry: entry["line"]
            ),
            "\n",
        ).alias("answer")
    )
    return (
        queries.select("query_id")
        .join(listed, "query_id", "left")
        .select("query_id", F.coalesce("answer", F.lit(NOTHING_FOUND)).alias("answer"))
    )
