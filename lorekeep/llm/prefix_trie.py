"""Trie of conversations: which turns many conversations begin with, and what sharing them saves.

Turns are numbered by a dictionary, so a conversation is a row of numbers. Equal ones are one sequence with a count; the
sequences are sorted by range over the tasks. A task puts runs of neighbouring sequences, shards, into ternary
search trees: the middle sequence goes in first, then the middles of both halves, and so on, which keeps the
trees flat. A walk over a tree, with a stack, adds up members, leaves and savings. Nodes on the path
of a shard's first or last sequence may go on in the neighbouring shard: these are given with their parts, which are merged over all
shards, and sums climb the merged nodes by doubling steps.

Conversations may be of any length: turns are numbered by a sort that parts a long conversation among tasks, and sequences are cut
into segments. A segment's tree hangs below the node at which the segment before it ends, which is a boundary node too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lorekeep.session import materialise, scratch_path

# Turns of a segment; a row holds one.
SEGMENT = 1024
# Turns of a shard, whose trees are in memory together.
SHARD = 1 << 17
# Most turns that a conversation takes from the first of its hundred, plus one.
HEADS = 6
# Bytes of ids that are joined into one piece before they are hashed.
PIECE = 1 << 16
# Merged boundary nodes up to this number are broadcast to the nodes below them.
BROADCAST_NODES = 100_000
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
_NONE = np.iinfo(np.int64).max


def shared_turns(conv_id: str = "conv_id") -> Column:
    """Turns that a conversation takes from the first of its hundred."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % HEADS).cast("int")


def _coded(conversations: DataFrame, path: str) -> DataFrame:
    """``conv, turn, digest, row, id, n_chars``: turns with their numbers in the dictionary of distinct roles and texts."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows.write.parquet(f"{path}/turns")
    turns = conversations.sparkSession.read.parquet(f"{path}/turns")
    # Numbers are data from the time of writing on, whatever is computed again.
    turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()).write.parquet(f"{path}/dictionary")
    return turns.join(conversations.sparkSession.read.parquet(f"{path}/dictionary"), "digest")


def _runs(turns: DataFrame, path: str, segment: int) -> DataFrame:
    """``conv, start, n, ids, sizes``: the turns of each conversation in order, in rows of up to ``segment`` turns.

    One sort over all turns; a long conversation spans tasks. The turns that stand in the tasks before are counted from the
    first and last conversation of each task, the only ones that can span several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first, conv, start, ids, sizes = True, None, 0, [], []

        def out(last: bool) -> pa.RecordBatch:
            row = {"part": part, "conv": conv, "place": start, "edge": first or last, "n": len(ids), "ids": ids, "sizes": sizes}
            return pa.RecordBatch.from_pylist([row], schema=_RUNS)

        for batch in batches:
            for name, number, size in zip(*(batch.column(x).to_pylist() for x in ("conv", "id", "n_chars"))):
                if name != conv and ids:
                    yield out(False)
                    first, start, ids, sizes = False, 0, [], []
                elif len(ids) == segment:
                    yield out(False)
                    start, ids, sizes = start + len(ids), [], []
                conv = name
                ids.append(number)
                sizes.append(size)
        if ids:
            yield out(True)

    # The last two columns part turns that are equal in all else.
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    sorted_turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "id", "n_chars")
    schema = "part long, conv long, place long, edge boolean, n long, ids array<long>, sizes array<long>"
    sorted_turns.mapInArrow(run, schema).write.parquet(f"{path}/runs")
    runs = turns.sparkSession.read.parquet(f"{path}/runs")
    edges = runs.filter("edge").select("part", "conv").distinct()  # two rows a task at most
    counts = runs.join(F.broadcast(edges), ["part", "conv"], "left_semi").groupBy("part", "conv").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.withColumn("carried", F.sum("n").over(before)).filter("carried IS NOT NULL").select("part", "conv", "carried")
    start = F.col("place") + F.coalesce("carried", F.lit(0))
    return runs.join(F.broadcast(carried), ["part", "conv"], "left").select("conv", start.alias("start"), "n", "ids", "sizes")


_RUNS = pa.schema(
    [("part", pa.int64()), ("conv", pa.int64()), ("place", pa.int64()), ("edge", pa.bool_()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
)


def rebuilt(conversations: DataFrame, path: str, segment: int = SEGMENT) -> DataFrame:
    """``conv, seg, ids, sizes, n_turns``: the rebuilt conversations in segments; each has a segment 0, empty if it has no turns.

    ``conversations`` has ``conv_id, turn, role, text``; equal turns of a conversation follow by a digest of role and text.
    """
    runs = _runs(_coded(conversations, path), path, segment)
    convs = runs.groupBy("conv").agg(F.sum("n").alias("n_own")).withColumn("h", shared_turns("conv"))
    # The first turns of the first of each hundred: rows of a few numbers.
    few = lambda name: F.slice(name, 1, HEADS - 1).alias(name)
    head = (
        runs.filter((F.col("conv") % 100 == 0) & (F.col("start") < HEADS - 1))
        .groupBy(F.col("conv").alias("_base"))
        .agg(F.sort_array(F.collect_list(F.struct("start", few("ids"), few("sizes")))).alias("runs"))
    )
    flat = lambda name: F.slice(F.flatten(F.transform("runs", lambda x: x[name])), 1, HEADS - 1).alias(f"_{name}")
    head = head.select("_base", flat("ids"), flat("sizes"))
    convs = convs.join(head, F.col("conv") - F.col("conv") % 100 == F.col("_base"), "left")
    taken = lambda name: F.when(F.col("_base").isNull(), F.array().cast("array<long>")).otherwise(F.slice(f"_{name}", 1, F.col("h")))
    convs = convs.select("conv", "h", "n_own", taken("ids").alias("ids"), taken("sizes").alias("sizes"))
    convs = convs.withColumn("k", F.size("ids").cast("long"))
    convs = materialise(convs.withColumn("n_turns", F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))))

    # The head of every conversation, also an empty one, and what is left of its own turns.
    heads = convs.select("conv", "n_turns", F.lit(0).cast("long").alias("at"), "ids", "sizes")
    dropped = F.greatest(F.col("h") - F.col("start"), F.lit(0))
    rest = lambda name: F.slice(name, (F.col("_drop") + 1).cast("int"), (F.col("n") - F.col("_drop")).cast("int")).alias(name)
    own = (
        runs.join(convs.select("conv", "h", "k", "n_turns"), "conv")
        .withColumn("_drop", dropped)
        .filter("_drop < n")
        .select("conv", "n_turns", (F.col("start") + F.col("_drop") - F.col("h") + F.col("k")).alias("at"), rest("ids"), rest("sizes"))
    )
    last = F.col("at") + F.greatest(F.size("ids"), F.lit(1)) - 1
    # A row of up to ``segment`` turns lies in two segments at most.
    cut = heads.unionByName(own).withColumn("seg", F.explode(F.sequence(F.expr(f"at DIV {segment}"), F.floor(last / segment))))
    low = F.greatest(F.col("seg") * segment - F.col("at"), F.lit(0))
    piece = lambda name: F.slice(name, (low + 1).cast("int"), F.lit(segment) - ((F.col("at") + low) % segment).cast("int")).alias(name)
    cut = cut.select("conv", "n_turns", "seg", (F.col("at") + low).alias("at"), piece("ids"), piece("sizes"))
    pieces = cut.groupBy("conv", "seg").agg(
        F.first("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("at", "ids", "sizes"))).alias("pieces")
    )
    joined = lambda name: F.flatten(F.transform("pieces", lambda x: x[name])).alias(name)
    return pieces.select("conv", "seg", joined("ids"), joined("sizes"), "n_turns")


def _sequences(segments: DataFrame, segment: int) -> DataFrame:
    """``seg, root, next, ids, sizes, n, conv, goes_on, ends`` of the distinct segments with equal turns before them.

    ``root`` names the turns before the segment, ``next`` those up to its end; ``ends`` is the digest of the conversations
    that end there.
    """
    own = [F.xxhash64(F.lit(salt), "seg", "ids").alias(f"h{salt}") for salt in (1, 2)]
    named = materialise(segments.select("*", *own))
    # Names of what comes before: only conversations of several segments have any. Rows of a few numbers, one a segment.
    before = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    long = named.filter(F.col("n_turns") > segment).select("conv", "seg", "h1", "h2")
    roots = long.select("conv", "seg", *[F.coalesce(F.bit_xor(f"h{x}").over(before), F.lit(0)).alias(f"r{x}") for x in (1, 2)])
    named = named.join(roots, ["conv", "seg"], "left").fillna(0, ["r1", "r2"])
    named = named.withColumn("goes_on", F.col("n_turns") > (F.col("seg") + 1) * segment)
    key = ["seg", "r1", "r2", "h1", "h2", "ids"]
    ended = named.filter(~F.col("goes_on")).select("seg", "r1", "r2", "h1", "h2", "conv")
    ends = _digests(ended)
    groups = named.groupBy(*key).agg(
        F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv").alias("conv"), F.max("goes_on").alias("goes_on")
    )
    return groups.join(ends, ["seg", "r1", "r2", "h1", "h2"], "left").withColumns(
        {"n1": F.col("r1").bitwiseXOR(F.col("h1")), "n2": F.col("r2").bitwiseXOR(F.col("h2"))}
    )


def _digests(ended: DataFrame) -> DataFrame:
    """SHA-256 of the conversations ``conv`` of each key, in ascending order.

    A key's ids are sorted by many tasks, which join them into pieces of text; one task hashes the pieces of a
    key one after the other and holds one at a time.
    """
    key = [name for name in ended.columns if name != "conv"]
    kinds = ", ".join(f"{name} long" for name in key)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, last, held, size = TaskContext.get().partitionId(), 0, None, [], 0

        def out() -> pa.RecordBatch:
            row = dict(zip(key, last)) | {"part": part, "place": place, "ids": ",".join(held)}
            return pa.RecordBatch.from_pydict({name: [value] for name, value in row.items()})

        for batch in batches:
            for *own, conv in zip(*(batch.column(name).to_pylist() for name in (*key, "conv"))):
                if held and (own != last or size > PIECE):
                    yield out()
                    place, held, size = place + 1, [], 0
                last = own
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield out()

    def hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[*key, "ends"])

        for batch in batches:
            for *own, ids in zip(*(batch.column(name).to_pylist() for name in (*key, "ids"))):
                if own != last:
                    if digest:
                        done.append((*last, digest.hexdigest()))
                    last, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if len(done) > 10_000:
                yield out()
                done = []
        if digest:
            done.append((*last, digest.hexdigest()))
        if done:
            yield out()

    ordered = ended.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")
    pieces = ordered.mapInArrow(join, f"{kinds}, part long, place long, ids string")
    gathered = pieces.repartition(*key).sortWithinPartitions(*key, "part", "place").select(*key, "ids")
    return gathered.mapInArrow(hash_pieces, f"{kinds}, ends string")


class Shard:
    """Ternary search trees over sequences that follow one another in the sort.

    A node of a tree stands for a turn behind the turns above it: ``low`` and ``high`` lead to nodes of smaller and
    greater numbers in its place, ``equal`` to the turn that follows. ``up`` is the trie node above.
    """

    def __init__(self) -> None:
        self.number: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.equal: list[int] = []
        self.up: list[int] = []
        self.size: list[int] = []
        self.n: list[int] = []
        self.conv: list[int] = []
        self.last: list[dict | None] = []  # the sequence that ends here
        self.trees: list[int] = []

    def _node(self, number: int, up: int, size: int) -> int:
        for values, value in zip(
            (self.number, self.low, self.high, self.equal, self.up, self.size, self.n, self.conv, self.last),
            (number, -1, -1, -1, up, size, 0, _NONE, None),
        ):
            values.append(value)
        return len(self.number) - 1

    def tree(self, sequences: list[dict]) -> int:
        """A tree of sorted sequences with one root: medians first, from a stack of ranges."""
        root = self._node(0, -1, 0)
        self.trees.append(root)
        ranges = [(0, len(sequences))]
        while ranges:
            start, stop = ranges.pop()
            if start < stop:
                middle = (start + stop) // 2
                self._insert(root, sequences[middle])
                ranges += [(start, middle), (middle + 1, stop)]
        return root

    def _insert(self, root: int, sequence: dict) -> None:
        at, n, conv = root, sequence["n"], sequence["conv"]
        self.n[at] += n
        self.conv[at] = min(self.conv[at], conv)
        for number, size in zip(sequence["ids"], sequence["sizes"]):
            found = self.equal[at]
            if found < 0:
                found = self.equal[at] = self._node(number, at, size)
            while self.number[found] != number:
                side = self.low if number < self.number[found] else self.high
                if side[found] < 0:
                    side[found] = self._node(number, at, size)
                found = side[found]
            at = found
            self.n[at] += n
            self.conv[at] = min(self.conv[at], conv)
        self.last[at] = sequence

    def path(self, root: int, ids: list[int]) -> list[int]:
        """The nodes along a sequence that is in the tree."""
        path = [root]
        for number in ids:
            at = self.equal[path[-1]]
            while self.number[at] != number:
                at = (self.low if number < self.number[at] else self.high)[at]
            path.append(at)
        return path

    def walk(self, root: int) -> list[tuple[int, int]]:
        """Nodes from ``root`` on with their depths: each before what is below it, neighbours in ascending order."""
        order, stack = [], [(root, 0, True)]
        while stack:
            at, depth, reached = stack.pop()
            if reached:
                order.append((at, depth))
                stack.append((self.equal[at], depth + 1, False))
            elif at >= 0:
                stack += [(self.high[at], depth, False), (at, depth, True), (self.low[at], depth, False)]
        return order


_KINDS = {"ends": "string", "boundary": "boolean", "key": "binary", "parent_key": "binary"}
_NODE = ("conv", "depth", "parent_conv", "n", "n_children", "n_leaves", "saved", "ends", "boundary", "key", "parent_key", "size")
NODE = ", ".join(f"{name} {_KINDS.get(name, 'long')}" for name in _NODE)


def _key_of(seg: int, first: int, second: int, ids: list[int]) -> bytes:
    """Names the turns before a segment and the first of its own."""
    head = np.array([seg, first, second], "<i8").tobytes()
    return hashlib.blake2b(head + np.array(ids, "<i8").tobytes(), digest_size=16).digest() if ids else head


def _whole_key(seg: int, first: int, second: int) -> bytes:
    """Names the turns before a segment, as the end of the segment before does."""
    return np.array([seg, first, second], "<i8").tobytes()


def _shard_nodes(sequences: list[dict], segment: int) -> Iterator[dict]:
    """Nodes of a shard: complete ones, and boundary ones with the parts that this shard knows."""
    shard, groups = Shard(), []
    for sequence in sequences:
        own = (sequence["seg"], sequence["r1"], sequence["r2"])
        if not groups or groups[-1][0] != own:
            groups.append((own, []))
        groups[-1][1].append(sequence)
    for place, ((seg, first, second), members) in enumerate(groups):
        root = shard.tree(members)
        open_nodes = {root} if seg else set()
        for sequence in (*members[: place == 0], *members[-1:][: place == len(groups) - 1], *(x for x in members if x["goes_on"])):
            open_nodes.update(shard.path(root, sequence["ids"]))
        order = shard.walk(root)
        children, leaves, saved = {}, {}, {}
        for at, _ in reversed(order):
            # What is below a node has been added up; a boundary node keeps its own savings for the merge.
            below = children.get(at, 0)
            own_saved = 0 if at in open_nodes else (shard.n[at] - 1) * shard.size[at]
            leaves[at] = leaves.get(at, 0) + (below == 0 and at not in open_nodes)
            saved[at] = saved.get(at, 0) + own_saved
            up = shard.up[at]
            if up >= 0 and at not in open_nodes:
                children[up] = children.get(up, 0) + 1
                leaves[up] = leaves.get(up, 0) + leaves[at]
                saved[up] = saved.get(up, 0) + saved[at]
        names: dict[int, bytes] = {}
        prefix: list[int] = []
        for at, depth in order:
            del prefix[max(depth - 1, 0) :]
            if depth:
                prefix.append(shard.number[at])
            up, last = shard.up[at], shard.last[at]
            boundary = at in open_nodes
            if boundary:
                if depth == segment:
                    names[at] = _whole_key(seg + 1, last["n1"], last["n2"])
                else:
                    names[at] = _key_of(seg, first, second, prefix)
            again = depth == 0 and seg > 0  # the node at the end of the segment before; it has told its members
            yield {
                "conv": None if again else shard.conv[at],
                "depth": seg * segment + depth,
                "parent_conv": None if boundary or up < 0 or up in open_nodes else shard.conv[up],
                "n": 0 if again else shard.n[at],
                "n_children": children.get(at, 0),
                "n_leaves": leaves[at],
                "saved": saved[at],
                "ends": None if again or last is None else last["ends"],
                "boundary": boundary,
                "key": names.get(at),
                "parent_key": names.get(up),
                "size": None if again else shard.size[at],
            }


def _nodes(sequences: DataFrame, path: str, segment: int, shard: int) -> DataFrame:
    """Nodes of all shards, written to the shared folder."""
    arrow = {"string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "long": pa.int64()}
    schema = pa.schema([(name, arrow[_KINDS.get(name, "long")]) for name in _NODE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(members: list[dict]) -> Iterator[pa.RecordBatch]:
            rows = []
            for node in _shard_nodes(members, segment):
                rows.append(node)
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        held, turns = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                turns += len(row["ids"]) + 1
                if turns >= shard:
                    yield from out(held)
                    held, turns = [], 0
        if held:
            yield from out(held)

    order = ["seg", "r1", "r2", "ids"]
    columns = ["seg", "r1", "r2", "n1", "n2", "ids", "sizes", "n", "conv", "goes_on", "ends"]
    shards = sequences.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    shards.mapInArrow(run, NODE).write.parquet(f"{path}/nodes")
    return sequences.sparkSession.read.parquet(f"{path}/nodes")


def _merged(boundary: DataFrame) -> DataFrame:
    """Boundary nodes, one row each: parts of all shards together, and sums over all that is below."""
    whole = boundary.groupBy("key").agg(
        F.min("conv").alias("conv"),
        F.max("depth").alias("depth"),
        F.max("parent_key").alias("parent_key"),
        F.sum("n").alias("n"),
        F.sum("n_children").alias("inner"),
        F.sum("n_leaves").alias("leaves"),
        F.sum("saved").alias("inner_saved"),
        F.max("ends").alias("ends"),
        F.max("size").alias("size"),
    )
    under = whole.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("_key")).agg(F.count("*").alias("_n"))
    whole = whole.join(under, F.col("key") == F.col("_key"), "left")
    whole = whole.withColumn("n_children", F.col("inner") + F.coalesce("_n", F.lit(0)))
    whole = materialise(
        whole.select(
            "key", "conv", "depth", "parent_key", "n", "n_children", "ends",
            (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
            (F.col("inner_saved") + (F.col("n") - 1) * F.col("size")).alias("saved"),
        )
    )
    # After step i a node has the sums of what is less than 2**i below, and knows the node 2**i above.
    step = whole.select("key", F.col("parent_key").alias("far"), "n_leaves", "saved")
    while not step.filter("far IS NOT NULL").isEmpty():
        given = step.filter("far IS NOT NULL").groupBy(F.col("far").alias("_to")).agg(
            F.sum("n_leaves").alias("_leaves"), F.sum("saved").alias("_saved")
        )
        above = step.select(F.col("key").alias("_above"), F.col("far").alias("_far"))
        step = (
            step.join(given, F.col("key") == F.col("_to"), "left")
            .join(above, F.col("far") == F.col("_above"), "left")
            .select(
                "key",
                F.col("_far").alias("far"),
                (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"),
            )
        )
        step = materialise(step)
    sums = step.select("key", "n_leaves", "saved")
    return materialise(whole.drop("n_leaves", "saved").join(sums, "key"))


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations of ``conv_id, turn, role, text``.

    ``conv_id`` is the smallest member, ``depth`` the number of turns, ``parent_conv_id`` the smallest member of the node
    above (null for the root); ``n_convs`` members, ``n_children`` children; ``n_leaves`` and ``saved_tokens`` are over the subtree,
    ``ends_sha256`` is of the members that end here.

    Turns are in order of ``turn``, null first; equal ones follow by a digest of role and text; rows that repeat are turns of
    their own. Null roles and texts are empty. Rows without a ``conv_id`` belong to no conversation. A
    conversation of any length is cut into segments of ``segment`` turns; results do not depend on that, nor on ``shard``,
    the turns whose trees a task holds together. Empty input gives no rows. Other columns are left behind.
    """
    spark: SparkSession = conversations.sparkSession
    path = scratch_path(spark, "trie")
    turns = rebuilt(conversations.select("conv_id", "turn", "role", "text"), path, segment)
    nodes = _nodes(_sequences(turns, segment), path, segment, shard)
    merged = _merged(nodes.filter("boundary"))
    few = merged.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    above = merged.select(F.col("key").alias("_above"), F.col("conv").alias("_conv"))
    above = F.broadcast(above) if few else above
    inner = nodes.filter("NOT boundary")
    known = inner.filter("parent_key IS NULL").drop("key", "parent_key", "size", "boundary")
    named = lambda df: df.join(above, F.col("parent_key") == F.col("_above"), "left").withColumn("parent_conv", F.col("_conv"))
    columns = ["conv", "depth", "parent_conv", "n", "n_children", "n_leaves", "saved", "ends"]
    hung = named(inner.filter("parent_key IS NOT NULL"))
    all_nodes = known.select(*columns).unionByName(hung.select(*columns)).unionByName(named(merged).select(*columns))
    return all_nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_MEMBERS)).alias("ends_sha256"),
    )
