"""Listings, statistics, status and repair of the chunk store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lorekeep.functions import text as tx
from lorekeep.session import materialise

_FAILURE_WIDTH = 100


def list_chunks(
    chunks: DataFrame, source: str | None = None, file: str | None = None, preview: int | None = None
) -> DataFrame:
    """Chunks whose source contains both substrings, with a ``preview`` column on request."""
    for part in (source, file):
        if part:
            chunks = chunks.filter(F.col("source").contains(part))
    if preview:
        chunks = chunks.withColumn("preview", tx.preview(F.col("text"), preview))
    return chunks


def count_by_source(chunks: DataFrame) -> DataFrame:
    """Chunks per source, sorted by source."""
    return (
        chunks.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"))
        .agg(F.count("*").alias("chunks"))
        .orderBy("source")
    )


def distinct_sources(chunks: DataFrame) -> DataFrame:
    """Each source once, sorted; rows rather than one list, which could not be bounded."""
    return chunks.select("source").distinct().orderBy("source")


def memory_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, sources, chunks with a payload, characters stored."""
    return chunks.agg(
        F.count("*").alias("total_chunks"),
        F.countDistinct("source").alias("sources"),
        F.count("text").alias("payloads"),
        F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("characters"),
    )


def find_by_text(chunks: DataFrame, text: str | Column) -> DataFrame:
    """The chunk with exactly this text, by its hash."""
    wanted = F.lit(text) if isinstance(text, str) else text
    return chunks.filter(F.col("hash") == tx.content_hash(wanted))


def latest_status(
    chunk_status: DataFrame, fields: Sequence[str] = ("status", "error", "questions")
) -> DataFrame:
    """The last recorded status of each chunk, with the number of attempts.

    Only the named fields of the log are read.
    """
    last = F.max_by(F.struct(*fields), "attempt").alias("last")
    return (
        chunk_status.groupBy("chunk_id")
        .agg(F.max("attempt").alias("attempt"), last)
        .select("chunk_id", "attempt", "last.*")
    )


def with_status(
    chunks: DataFrame, chunk_status: DataFrame, fields: Sequence[str] = ("status", "error", "questions")
) -> DataFrame:
    """Chunks with their current status; one without a record counts as complete."""
    joined = chunks.join(latest_status(chunk_status, fields), "chunk_id", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("complete")))


def by_status(chunks: DataFrame, chunk_status: DataFrame, status: str = "pending") -> DataFrame:
    """Chunks with this status. The log is filtered before chunks, and their texts, are joined to it."""
    if status == "complete":
        # These need no record.
        return with_status(chunks, chunk_status).filter(F.col("status") == status)
    return chunks.join(latest_status(chunk_status).filter(F.col("status") == status), "chunk_id")


def orphans(metadata: DataFrame, payload: DataFrame) -> DataFrame:
    """Metadata rows without a payload."""
    return metadata.join(payload.select("chunk_id"), "chunk_id", "left_anti")


def without_orphans(metadata: DataFrame, payload: DataFrame) -> DataFrame:
    """Metadata rows that have a payload."""
    return metadata.join(payload.select("chunk_id"), "chunk_id", "left_semi")


def _is(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def _success_rate() -> Column:
    """Percent complete, null when nothing was stored."""
    return (F.lit(100.0) * F.col("complete") / F.nullif(F.col("stored"), F.lit(0))).alias("success_rate")


_COUNTS = ("stored", "complete", "failed", "questions")


def _counts() -> list[Column]:
    generated = F.sum(F.when(F.col("status") == "complete", F.coalesce(F.size("questions"), F.lit(0))))
    return [
        F.count("*").alias("stored"),
        _is("complete").alias("complete"),
        _is("failed").alias("failed"),
        F.coalesce(generated, F.lit(0)).alias("questions"),
    ]


def batch_counts(batch: DataFrame) -> DataFrame:
    """One row: what a batch with ``status`` and ``questions`` stored."""
    return batch.agg(*_counts()).select(
        F.col("stored").alias("chunks_stored"),
        F.col("complete").alias("chunks_complete"),
        F.col("failed").alias("chunks_failed"),
        F.col("questions").cast("long").alias("questions_generated"),
    )


def ingest_stats(batch: DataFrame, store: DataFrame) -> DataFrame:
    """One row: what this batch stored, and what the whole store holds.

    Both inputs carry ``status`` and ``questions``. The batch counts are exact per batch; the
    store-wide ones have names of their own.
    """
    def tagged(rows: DataFrame, of_batch: bool, made: Column) -> DataFrame:
        return rows.select(F.lit(of_batch).alias("_batch"), "status", made.alias("_made"))

    made = F.when(F.col("status") == "complete", F.coalesce(F.size("questions"), F.lit(0)))
    both = tagged(batch, True, made).unionByName(tagged(store, False, F.lit(None).cast("int")))

    def counted(of_batch: bool, status: str | None = None) -> Column:
        inside = F.col("_batch") == of_batch
        return F.count_if(inside if status is None else inside & (F.col("status") == status))

    return both.agg(
        counted(True).alias("chunks_stored"),
        counted(True, "complete").alias("chunks_complete"),
        counted(True, "failed").alias("chunks_failed"),
        F.coalesce(F.sum("_made"), F.lit(0)).alias("questions_generated"),
        counted(False).alias("total_chunks"),
        counted(False, "complete").alias("total_complete"),
        counted(False, "failed").alias("total_failed"),
    )


def load_report(batch: DataFrame) -> DataFrame:
    """Per source: chunks stored, complete and failed, statements, success rate in percent."""
    return batch.groupBy("source").agg(*_counts()).select("source", *_COUNTS, _success_rate())


def load_total(report: DataFrame) -> DataFrame:
    """The same figures for the whole run, from the per-source rows."""
    totals = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in _COUNTS]
    return report.agg(F.count("*").alias("sources"), *totals).select("sources", *_COUNTS, _success_rate())


def failures(batch: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` failed chunks with a shortened error, and how many failed in all."""
    shown = F.concat(F.substring("error", 1, _FAILURE_WIDTH), F.lit("..."))
    # Counted and listed: materialised, so that the batch is evaluated once.
    failed = materialise(batch.filter(F.col("status") == "failed").select("source", "chunk_id", shown.alias("error")))
    return (
        failed.orderBy("source", "chunk_id")
        .limit(n)
        .select(
            "source",
            "chunk_id",
            "error",
            failed.agg(F.count("*")).scalar().alias("total_failed"),
        )
    )


# The answers to a store call.
STORED_NOTHING = (
    "Information NOT stored - this appears to be a duplicate or already exists in memory. "
    "No need to store again."
)
STORED_ONE = "Stored 1 new chunk in memory successfully."
STORED_MANY = "Stored %d new chunks in memory successfully."


def store_outcome(stored: Column) -> Column:
    """Text for the number of new chunks."""
    return (
        F.when(stored == 0, STORED_NOTHING)
        .when(stored == 1, STORED_ONE)
        .otherwise(F.format_string(STORED_MANY, stored))
    )
