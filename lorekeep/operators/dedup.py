"""First-writer-wins deduplication and dense ids, without a hot group or a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lorekeep.session import materialise

INGEST_ORDER = ("source", "doc_key", "pos")
# Keys that may be broadcast: 32 characters each.
BROADCAST_KEYS = 500_000


def first_occurrence(
    chunks: DataFrame, key: str = "hash", order: Sequence[str] = INGEST_ORDER
) -> DataFrame:
    """One row per ``key``: the first in ``order``.

    An aggregate, not a window: copies collapse before the shuffle, so a text that makes up a
    third of the input sends one row per task.
    """
    first = F.min_by(F.struct(*chunks.columns), F.struct(*order))
    return chunks.groupBy(key).agg(first.alias("first")).select("first.*")


def without_stored(
    chunks: DataFrame, stored: DataFrame, key: str = "hash", rows: int | None = None
) -> DataFrame:
    """Rows whose ``key`` the store does not hold, whatever status it has there.

    ``rows`` is the number of chunks, where it is known. Few of them are broadcast to the scan of
    the store, of which then only the keys in question are moved; otherwise both sides are
    shuffled by key.
    """
    known = stored.select(key)
    if rows is not None and rows <= BROADCAST_KEYS:
        known = known.join(F.broadcast(chunks.select(key)), key, "left_semi")
    return chunks.join(known, key, "left_anti")


def dedup_chunks(
    chunks: DataFrame, stored: DataFrame | None = None, order: Sequence[str] = INGEST_ORDER
) -> DataFrame:
    """New chunks only: first occurrence in the batch, unknown to the store."""
    fresh = first_occurrence(chunks, order=order)
    return fresh if stored is None else without_stored(fresh, stored)


def assign_ids(
    chunks: DataFrame, next_id: int = 0, order: Sequence[str] = INGEST_ORDER
) -> DataFrame:
    """Dense ascending ``chunk_id`` in ``order``, starting at ``next_id``.

    A range-partitioned sort is materialised once; the row number inside a partition plus the
    sizes of the partitions before it give the id. Only the partition sizes meet in one task.
    """
    ordered = materialise(chunks.orderBy(*order)).withColumns(
        {"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}
    )
    # The id generator keeps the partition in the upper bits and the row in the lower 33.
    ordered = ordered.withColumn("_row", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    # One row per partition: bounded by the partition count, so safe to broadcast.
    numbered = ordered.join(F.broadcast(offsets), "_part")
    return numbered.select(
        (F.lit(next_id) + F.col("_offset") + F.col("_row")).cast("long").alias("chunk_id"),
        *chunks.columns,
    )
