"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A document is the bag of its five-word shingles, weighted by how often they occur. Every shingle sends
arrivals of a Poisson process whose rate is its weight, each to a random register; a register keeps its
first arrival. Two documents agree in a register with the probability of their probability Jaccard
similarity. Arrivals are drawn only up to the time at which all registers are bound to be full, so in a long
document nearly every shingle ends after its first draw.

Registers are cut into bands. Texts that are equal are one vertex from the start. A text is first held against
the leader that it meets in most of its buckets, which joins most of what is alike with one comparison a
text. Buckets that still hold several components are then settled whole: each is an exact join of its bags. Two
bags are similar only if they share one of the rarest shingles of both, so in a bucket the join looks at few
pairs, and no pair leaves its task unless it is a link that joins two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lorekeep.llm.common import hidden, map_rows, shown, small
from lorekeep.llm.components import components, roots
from lorekeep.llm.hashing import mix64, shingles
from lorekeep.session import materialise, scratch_path

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
# Rows and shingles of a block; the rows of a bucket meet in a task two blocks at a time.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
# Bytes of a shingle's name in a bag: 40 bits are shared by one of two million shingles in a text of as many.
_NAME = 5
_GOLDEN = 0x9E3779B97F4A7C15
# Distinct shingles from which on their hashes are kept in 64 bits; below it, 40 bits meet once in a million texts.
_WIDE = 1 << 16


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order and how often each occurs."""
    return np.unique(shingles(text, SHINGLE), return_counts=True)


def _waits(random: np.ndarray) -> np.ndarray:
    """Exponential waiting times from 64 random bits each."""
    return -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))


def signature(keys: np.ndarray, weights: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The shingle that comes first in each of ``m`` registers; zeros for an empty bag."""
    found = np.zeros(m, np.uint64)
    if not len(keys):
        return found
    # Until this time m * (ln m + 4) arrivals are expected in all; they leave a register empty in two bags of 100.
    until = m * (np.log(m) + 4) / float(weights.sum())
    random = mix64(keys + np.uint64(_GOLDEN))
    first = _waits(random) / weights
    while True:
        on_time = first <= until
        live, rates = keys[on_time], weights[on_time].astype(np.float64)
        times, places, names = [first[on_time]], [random[on_time]], [live]
        start, draw = times[0], 1
        while len(live):
            # The next draws of all live shingles, as many as nearly all of them will need.
            mean = float((rates * (until - start)).max())
            columns = np.arange(draw + 1, draw + 2 + int(mean + 3 * np.sqrt(mean)), dtype=np.uint64)
            more = mix64(live[:, None] + columns * np.uint64(_GOLDEN))
            steps = np.cumsum(_waits(more) / rates[:, None], axis=1) + start[:, None]
            inside = steps <= until
            times.append(steps[inside])
            places.append(more[inside])
            names.append(np.broadcast_to(live[:, None], more.shape)[inside])
            going = inside[:, -1]
            live, rates, start, draw = live[going], rates[going], steps[going, -1], draw + len(columns)
        order = np.argsort(np.concatenate(times))[::-1]  # the first arrival is written last
        place = (mix64(np.concatenate(places)) % np.uint64(m)).astype(np.int64)
        found[place[order]] = np.concatenate(names)[order]
        if len(np.unique(place)) == m:
            return found
        until *= 2


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two bags: 1 for proportional bags, 0 for disjoint ones."""
    shared, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    mine, theirs = a[1].astype(np.float64), b[1].astype(np.float64)
    only_a, only_b = mine.sum() - mine[at_a].sum(), theirs.sum() - theirs[at_b].sum()
    mine, theirs = mine[at_a], theirs[at_b]
    total = 0.0
    for ratio, count in zip(*np.unique(mine / theirs, return_counts=True)):
        # Shingles with this ratio of weights: each has 1 / sum of max(weight a / own a, weight b / own b).
        total += np.sum(mine[mine / theirs == ratio]) / (np.maximum(mine, theirs * ratio).sum() + only_a + only_b * ratio)
    return float(total)


def vertex(text: str = "text") -> Column:
    """Equal texts are one vertex; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def signed(docs: DataFrame) -> DataFrame:
    """``v, bands, size`` per row; ``size`` counts distinct shingles. Texts without a word have no bands."""

    def step(batch: pa.RecordBatch):
        bands, sizes = [], []
        for text in batch.column("text").to_pylist():
            names, weights = bag(text)
            found = signature(names, weights)
            keys = np.zeros(BANDS, np.uint64)
            for at in range(ROWS):
                keys = mix64(keys * np.uint64(31) + found[at::ROWS])
            keys = mix64(keys + np.arange(BANDS, dtype=np.uint64))
            bands.append(keys.view(np.int64) if found.any() else [])
            sizes.append(len(names))
        yield {"v": batch.column("v"), "bands": bands, "size": sizes}

    return map_rows(docs.select(vertex().alias("v"), "text"), "v binary, bands array<long>, size long", step)


def bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``v, bag, counts`` of the vertices in ``wanted`` (``v``): packed names in ascending order; counts if any is above 1."""

    def step(batch: pa.RecordBatch):
        packed = []
        for text in batch.column("text").to_pylist():
            names, counts = bag(text)
            names, first = np.unique(names >> np.uint64(64 - 8 * _NAME), return_index=True)
            counts = counts[first].astype("<u4")
            data = names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_NAME].tobytes()
            packed.append((data, counts.tobytes() if len(counts) and counts.max() > 1 else b""))
        yield {"v": batch.column("v"), "bag": [one for one, _ in packed], "counts": [two for _, two in packed]}

    rows = docs.select(vertex().alias("v"), "text")
    if small(wanted):
        made = map_rows(rows.join(F.broadcast(wanted), "v", "left_semi"), "v binary, bag binary, counts binary", step)
    else:
        # Bags are smaller than texts, so they are made before they meet the many that are wanted.
        made = map_rows(rows, "v binary, bag binary, counts binary", step).join(wanted, "v", "left_semi")
    return made.groupBy("v").agg(F.first("bag").alias("bag"), F.first("counts").alias("counts"))


def _opened(data: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.zeros((len(data) // _NAME, 8), np.uint8)
    names[:, :_NAME] = np.frombuffer(data, np.uint8).reshape(-1, _NAME)
    names = names.view("<u8").ravel()
    return names, np.frombuffer(counts, "<u4") if counts else np.ones(len(names), np.uint32)


def _held(pairs: DataFrame, made: DataFrame, similar: float) -> DataFrame:
    """The pairs ``v, leader`` whose bags are similar."""

    def check(batch: pa.RecordBatch):
        columns = [batch.column(name).to_pylist() for name in ("bag", "counts", "_bag", "_counts")]
        same = [similarity(_opened(a, b), _opened(c, d)) >= similar - 1e-9 for a, b, c, d in zip(*columns)]
        yield batch.select(["v", "leader"]).filter(pa.array(same, pa.bool_()))

    theirs = made.select(F.col("v").alias("leader"), F.col("bag").alias("_bag"), F.col("counts").alias("_counts"))
    beside = pairs.join(made, "v").join(theirs, "leader").select("v", "leader", "bag", "counts", "_bag", "_counts")
    return map_rows(beside, "v binary, leader binary", check)


class _Forest:
    """Components of a task's rows, by union and find."""

    def __init__(self, labels: list[bytes]) -> None:
        number = {label: at for at, label in enumerate(dict.fromkeys(labels))}
        self.of = np.array([number[label] for label in labels], np.int64)
        self.top = np.arange(len(number))

    def roots(self, rows: np.ndarray) -> np.ndarray:
        tops = self.top[self.of[rows]]
        while (above := self.top[tops]).tolist() != tops.tolist():
            tops = above
        return tops

    def join(self, x: int, y: int) -> bool:
        x, y = self.roots(np.array([x, y])).tolist()
        self.top[max(x, y)] = min(x, y)
        return x != y


def links_between(labels: list[bytes], opened: list[tuple[np.ndarray, np.ndarray]], sides: np.ndarray | None, similar: float) -> list[tuple[int, int]]:
    """Similar pairs of rows with different labels: enough of them to join all components that similar pairs join.

    The similarity is at most the sum of the smaller shares of every shingle. So what two similar bags have in common
    is not all behind their first shingles, in any one order, that make up ``1 - similar`` of a bag; rare ones come
    first. With ``sides``, only rows of different sides are compared.
    """
    forest = _Forest(labels)
    if len(forest.top) < 2:
        return []
    sizes = np.array([len(names) for names, _ in opened])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    _, name, often = np.unique(np.concatenate([names for names, _ in opened]), return_inverse=True, return_counts=True)
    share = np.concatenate([counts / counts.sum() for _, counts in opened])
    row = np.repeat(np.arange(len(opened)), sizes)
    # Rarest first within each row, and the share of what stands before.
    order = np.lexsort((name, often[name], row))
    before = np.cumsum(share[order]) - share[order]
    before -= before[bounds[:-1]].repeat(sizes)
    front = order[before <= 1 - similar + 1e-9]
    # Only names in the fronts of two components can bring a pair together.
    component, names = forest.of[row[front]], name[front]
    low, high = np.full(len(often), len(forest.top)), np.full(len(often), -1)
    np.minimum.at(low, names, component)
    np.maximum.at(high, names, component)
    front = front[low[names] < high[names]]
    front = front[np.argsort(name[front], kind="stable")]
    starts = np.searchsorted(name[front], np.arange(len(often) + 1))
    rows = row[front]
    asked = np.argsort(row[front], kind="stable")
    asked_at = np.searchsorted(row[front][asked], np.arange(len(opened) + 1))
    share_of, found = np.zeros(len(often)), []
    for x in range(1, len(opened)):
        own = name[front[asked[asked_at[x] : asked_at[x + 1]]]]
        if not len(own):
            continue
        others = np.unique(np.concatenate([rows[starts[key] : starts[key + 1]] for key in own]))
        others = others[others < x]
        if sides is not None:
            others = others[sides[others] != sides[x]]
        if not len(others):
            continue
        others = others[forest.roots(others) != forest.roots(np.array([x]))[0]]
        if not len(others):
            continue
        mine = slice(bounds[x], bounds[x + 1])
        share_of[name[mine]] = share[mine]
        most = np.array([np.minimum(share_of[name[s]], share[s]).sum() for s in (slice(bounds[y], bounds[y + 1]) for y in others)])
        share_of[name[mine]] = 0
        for at in np.argsort(-most, kind="stable"):
            if most[at] < similar - 1e-9:
                break
            y = int(others[at])
            if forest.roots(np.array([x]))[0] != forest.roots(np.array([y]))[0] and similarity(opened[x], opened[y]) >= similar - 1e-9:
                forest.join(x, y)
                found.append((y, x))
    return found


def _settled(rows: DataFrame, made: DataFrame, similar: float) -> DataFrame:
    """Links ``a, b`` between the components ``label`` of ``bucket, v, label, size`` that share a bucket.

    A bucket of one block is one task. In a larger one the rows outside its largest component meet each other and all
    rows of that, two blocks at a time; rows of the largest component need not meet each other.
    """
    xor = [F.bit_xor(F.xxhash64("v", F.lit(salt))).alias(f"s{salt}") for salt in (1, 2)]
    per = rows.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("size").alias("size"), *xor)
    largest = F.max_by(F.struct("label", "c", "size"), F.struct("c", "label"))
    buckets = per.groupBy("bucket").agg(
        F.count("*").alias("k"), F.sum("c").alias("n"), F.sum("size").alias("all"), largest.alias("top"),
        *[F.bit_xor(f"s{salt}").alias(f"s{salt}") for salt in (1, 2)],
    )
    # Of buckets with the same rows one is enough.
    split = buckets.filter("k > 1").groupBy("n", "s1", "s2").agg(F.min_by(F.struct("bucket", "all", "top"), "bucket").alias("one"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    n, whole, top = F.col("n"), F.col("one.all"), F.col("one.top")
    split = split.select(
        F.col("one.bucket").alias("bucket"), top["label"].alias("_top"), (blocks(n, whole) == 1).alias("_single"),
        blocks(n - top["c"], whole - top["size"]).alias("_rest"), blocks(top["c"], top["size"]).alias("_tops"),
    )
    placed = rows.join(split, "bucket").withColumn("_side", (F.col("label") == F.col("_top")).cast("int"))
    own = F.pmod(F.hash("v"), F.when(F.col("_side") == 1, F.col("_tops")).otherwise(F.col("_rest")))
    task = lambda i, j, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
    zero = F.lit(0)
    upto = lambda count: F.sequence(zero, F.col(count) - 1)
    tasks = (
        F.when(F.col("_single"), F.array(task(zero, zero, 0)))
        .when(F.col("_side") == 1, F.transform(upto("_rest"), lambda i: task(i, F.col("_own"), 1)))
        .otherwise(
            F.concat(
                F.transform(upto("_rest"), lambda j: task(F.least("_own", j), F.greatest("_own", j), 0)),
                F.transform(upto("_tops"), lambda j: task(F.col("_own"), j, 1)),
            )
        )
    )
    placed = placed.withColumn("_own", own).select("bucket", F.explode(tasks).alias("t"), "v", "label", "_side")
    key = ["bucket", "i", "j", "kind"]
    placed = placed.select("bucket", "t.*", "v", "label", "_side").join(made, "v").select(*key, "label", "_side", "bag", "counts")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def out() -> pa.RecordBatch:
            labels = [row[0] for row in held]
            opened = [_opened(row[2], row[3]) for row in held]
            sides = np.array([row[1] for row in held]) if last[3] else None
            links = links_between(labels, opened, sides, similar)
            ends = [sorted((labels[x], labels[y])) for x, y in links]
            return pa.RecordBatch.from_arrays([pa.array([end[at] for end in ends], pa.binary()) for at in (0, 1)], names=["a", "b"])

        for batch in batches:
            for *task, label, side, data, counts in zip(*(column.to_pylist() for column in batch.columns)):
                if task != last and held:
                    yield out()
                    held = []
                last = task
                held.append((label, side, data, counts))
        if held:
            yield out()

    return placed.repartition(*key).sortWithinPartitions(*key).mapInArrow(settle, "a binary, b binary").distinct()


def _labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the component of the vertex in ``column``; a vertex without links is its own."""
    side = labels.select(F.col("v").alias("_v"), F.col("label").alias("_label"))
    joined = rows.join(side, F.col(column) == F.col("_v"), "left")
    return joined.withColumn(name, F.coalesce("_label", column)).drop("_v", "_label")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``v, label`` for the vertices that have links, ``label`` naming the class."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "near-dedup")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    vertices = signed(docs).groupBy("v").agg(F.first("bands").alias("bands"), F.first("size").alias("size"))
    banded = stored(vertices, "vertices").select("v", "size", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("v").alias("leader")).filter("_n > 1")
    members = stored(banded.join(buckets, "bucket").select("bucket", "v", "size", "leader"), "members")
    # The leader that a text meets in most buckets, the smaller one of several; the leader is the smaller vertex.
    met = members.filter("v != leader").groupBy("v", "leader").agg(F.count("*").alias("shared"))
    best = met.groupBy("v").agg(F.min_by("leader", F.struct(-F.col("shared"), "leader")).alias("leader"))
    made = stored(bags(docs, members.select("v").distinct()), "bags")
    labels = roots(stored(_held(best, made, similar), "links"))
    rows = _labelled(members, labels, "v", "label").select("bucket", "v", "label", "size")
    between = components(stored(_settled(rows, made, similar), "between"))
    above = between.select(F.col("v").alias("_v"), F.col("label").alias("_label"))
    below = labels.join(above, F.col("label") == F.col("_v"), "left").select("v", F.coalesce("_label", "label").alias("label"))
    # A label is no vertex of ``labels``: it has no leader itself.
    return materialise(below.unionByName(between))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``doc_id, group_id, group_size, kept`` for every row of ``docs`` (``doc_id, text``).

    ``group_id`` is the smallest id of the class, ``group_size`` its rows, ``kept`` true for the smallest id.
    Equal texts, the empty one and null included, are one class; texts without a word join no other class.
    Null ids come after all others; rows that repeat are rows of the class. Texts of fewer than five
    words have one shingle. Empty input gives no rows. Other columns are left behind.
    """
    docs = docs.select("doc_id", "text")
    labels = classes(docs, similar)
    rows = _labelled(docs.select("doc_id", vertex().alias("v")), labels, "v", "_class").select("doc_id", "_class")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    groups = rows.groupBy("_class").agg(F.min(order).alias("_first"), F.count("*").alias("group_size"))
    return rows.join(groups, "_class").select(
        "doc_id", F.col("_first.doc_id").alias("group_id"), "group_size",
        F.col("doc_id").eqNullSafe(F.col("_first.doc_id")).alias("kept"),
    )


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of ``docs`` per class, that with the smallest id, with all columns."""
    labels = classes(docs.select("doc_id", "text"), similar)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_vertex")
    narrow = _labelled(docs.select("doc_id", vertex().alias("_vertex")), labels, "_vertex", "_class")
    first = narrow.groupBy("_class").agg(F.min(order).alias("_first"))
    first = materialise(first.select(F.col("_first._vertex").alias("_v"), F.col("_first.doc_id").alias("_id"), "_class"))
    rows, names = hidden(docs)
    rows = rows.withColumn("_vertex", vertex(names["text"]))
    same = lambda name: (F.col("_vertex") == F.col("_v")) & F.col(name).eqNullSafe(F.col("_id"))
    kept = rows.join(first, same(names["doc_id"]))
    # A class keeps several rows only where a row repeats; if none does, texts need not meet once more.
    if docs.select("doc_id", vertex().alias("_vertex")).join(first, same("doc_id"), "left_semi").count() > first.count():
        kept = kept.dropDuplicates(["_class"])
    return shown(kept, names)
