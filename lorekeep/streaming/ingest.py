"""Incremental ingest of a document stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lorekeep import schemas
from lorekeep.plans.ingest import Models, ingest
from lorekeep.sources.store import Store


def ingest_stream(
    docs: DataFrame,
    store: Store,
    checkpoint: str,
    models: Models = Models(),
    size: int = schemas.CHUNK_SIZE,
    overlap: int = schemas.CHUNK_OVERLAP,
    retry_after: float | None = None,
    **trigger,
) -> StreamingQuery:
    """Ingest every micro-batch of ``doc_key, source, text`` rows.

    A replayed batch adds nothing: its chunks are already known by hash, and chunks whose vectors
    are missing are still pending and get them then. Only the first batch after a start can be a
    replay, so only that one looks for pending chunks of others. With ``retry_after`` every batch does, and tries
    those again that are due, so a long load needs no second pass.
    """
    started = False

    def add(batch: DataFrame, batch_id: int) -> None:
        nonlocal started
        resume = not started or retry_after is not None
        ingest(batch, store, models, size, overlap, resume=resume, retry_after=retry_after)
        started = True

    return (
        docs.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
