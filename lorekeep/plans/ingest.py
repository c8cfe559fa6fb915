"""Documents into the store."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lorekeep import schemas
from lorekeep.operators.chunking import chunk_documents
from lorekeep.operators.dedup import BROADCAST_KEYS, assign_ids, first_occurrence
from lorekeep.operators.memory import batch_counts, latest_status, with_status
from lorekeep.operators.models import EmbeddingModel, TextModel, explode_questions, index_chunks
from lorekeep.session import materialise
from lorekeep.sources.store import Store


@dataclass(frozen=True)
class Models:
    """The user's models; None stands for the defaults."""

    summarize: TextModel | None = None
    embed: EmbeddingModel | None = None
    dim: int = schemas.EMBEDDING_DIM


def new_chunks(docs: DataFrame, store: Store, size: int, overlap: int, next_id: int) -> tuple[DataFrame, DataFrame]:
    """Chunks the store does not hold, with ids from ``next_id`` on: without and with their texts.

    The batch is materialised once it is cut. Which chunks are new, and their ids, is decided on narrow rows;
    texts are joined to them by the row they were cut as.
    """
    cut = chunk_documents(docs.select("doc_key", "source", "text"), size, overlap)
    cut = materialise(cut.withColumn("_cut", F.monotonically_increasing_id()))
    batch = materialise(first_occurrence(cut.drop("text")))
    count = batch.count()
    known = store.known_hashes(batch, count)
    if count <= BROADCAST_KEYS:
        known = F.broadcast(known)
    fresh = assign_ids(batch.join(known, "hash", "left_anti"), next_id)
    numbered = fresh.select("_cut", "chunk_id")
    if count <= BROADCAST_KEYS:
        numbered = F.broadcast(numbered)
    return fresh.drop("_cut"), cut.join(numbered, "_cut").drop("_cut")


def _status(chunks: DataFrame, attempt: int, status, error=None, questions=None) -> DataFrame:
    return chunks.select(
        "chunk_id",
        F.lit(attempt).alias("attempt"),
        status.alias("status"),
        (F.lit(None) if error is None else error).cast("string").alias("error"),
        (F.lit(None) if questions is None else questions).cast("array<string>").alias("questions"),
    )


def store_pending(docs: DataFrame, store: Store, size: int, overlap: int, next_id: int) -> DataFrame:
    """Phase one: the new chunks are stored as pending. Returns them without their texts.

    The ids are reserved before they are written, so no later run gives them again. Then the status goes first: a
    chunk is never stored without one, and a status left by a failed run has no chunk and no effect. The hashes go
    last: those of a run that broke off before are added by the next.
    """
    added, texts = new_chunks(docs, store, size, overlap, next_id)
    count = added.count()
    if count:
        store.reserve(next_id, count)
    store.append_status(_status(added, 0, F.lit("pending")))
    store.append_chunks(texts)
    store.append_hashes(added, next_id + count)
    return added


def pending_chunks(store: Store, since: int = 0) -> tuple[DataFrame, DataFrame] | None:
    """Chunks from id ``since`` on that wait for vectors and are due, with the attempts made so far, and those of
    their ids that vectors are stored for (more than once where a chunk has several); None when there are none.

    Ids are dense and appended in order, so a range of ids lets the scans of the log and the texts
    skip the files and row groups of everything stored before. Where all of the range wait, as in a new batch, texts
    stay where they are; so they do where the ids that wait can be broadcast.
    """
    status = latest_status(store.chunk_status.filter(F.col("chunk_id") >= since), ("status", "next_try_at"))
    due = F.col("next_try_at").isNull() | (F.col("next_try_at") <= F.current_timestamp())
    # Kept as they are now: what is due may be asked more than once, and time goes on.
    waiting = materialise(status.filter((F.col("status") == "pending") & due).select("chunk_id", "attempt"))
    bounds = [f(name) for name in ("chunk_id", "attempt") for f in (F.min, F.max)]
    low, high, least, most, count = waiting.agg(*bounds, F.count("*")).first()
    if low is None:
        return None
    within = F.col("chunk_id").between(low, high)
    recent, held = store.chunks.filter(within), store.questions.select("chunk_id").filter(within)
    if count == high - low + 1 and least == most:
        return recent.withColumn("attempt", F.lit(least)), held
    if count <= BROADCAST_KEYS:
        waiting = F.broadcast(waiting)
    return recent.join(waiting, "chunk_id"), held.join(waiting, "chunk_id", "left_semi")


def index_pending(
    store: Store,
    models: Models,
    last: bool,
    since: int = 0,
    wait: float = 0.0,
    max_attempts: int | None = None,
    retry_after: float | None = None,
) -> bool:
    """Phase two: one attempt at every pending chunk that is due; those failing the ``last`` one are failed.

    ``max_attempts`` makes failed those that have had so many, each by its own count. With ``retry_after`` the others are
    due again that many seconds from now, doubled for every attempt they have had.

    Vectors go before the status, so that a chunk is only complete once it can be found. Vectors
    of an attempt that broke off are skipped when it is repeated. ``wait`` seconds pass before the attempt if
    any chunk is pending. False when none was.
    """
    found = pending_chunks(store, since)
    if found is None:
        return False
    time.sleep(wait)
    waiting, held = found
    done = index_chunks(waiting, models.summarize, models.embed, dim=models.dim)
    done = materialise(done.select("chunk_id", "attempt", "status", "error", "questions", "embeddings"))
    made = explode_questions(done)
    # Vectors are moved only where an attempt broke off.
    if not held.isEmpty():
        made = made.join(held, "chunk_id", "left_anti")
    store.append_questions(made)
    spent = F.lit(last)
    if max_attempts is not None:
        spent = spent | (F.col("attempt") + 1 >= max_attempts)
    outcome = F.when(F.col("status") == "complete", "complete").when(spent, "failed").otherwise("pending")
    again = F.lit(None).cast("timestamp")
    if retry_after is not None:
        seconds = F.lit(float(retry_after)) * F.pow(F.lit(2.0), F.col("attempt"))
        again = F.when(outcome == "pending", F.current_timestamp() + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))
    store.append_status(
        done.select(
            "chunk_id",
            (F.col("attempt") + 1).alias("attempt"),
            outcome.alias("status"),
            "error",
            F.when(F.col("status") == "complete", F.col("questions")).alias("questions"),
            again.alias("next_try_at"),
        )
    )
    return True


def ingest_batch(
    docs: DataFrame,
    store: Store,
    models: Models = Models(),
    size: int = schemas.CHUNK_SIZE,
    overlap: int = schemas.CHUNK_OVERLAP,
    max_attempts: int = 3,
    resume: bool = True,
    delay: float = 0.0,
    retry_after: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Store and index ``doc_key, source, text`` rows: (one row of statistics, the chunks of the batch).

    The chunks come with their status, error and statements, as ``load_report`` and ``failures`` take them.
    With ``resume``, pending chunks left by an earlier run are indexed as well: the log is read from the settled id on.
    Without it only the log entries of the new chunks are read. ``delay`` seconds, doubled each time, pass before a further attempt.

    With ``retry_after`` nothing waits: one attempt is made at what is due, and what fails it stays pending until so many
    seconds, doubled each time, have passed. ``retry_due`` or a later batch that resumes tries it again.
    """
    next_id = store.next_id()
    since = store.settled()[0] if resume else next_id
    added = store_pending(docs, store, size, overlap, next_id)
    if retry_after is not None:
        index_pending(store, models, False, since, max_attempts=max_attempts, retry_after=retry_after)
        max_attempts = 0
    for attempt in range(1, max_attempts + 1):
        wait = delay * 2 ** (attempt - 2) if attempt > 1 else 0.0
        if not index_pending(store, models, attempt == max_attempts, since, wait):
            break
    report = batch_report(added, store, next_id)
    return batch_stats(report, store), report


def retry_due(store: Store, models: Models = Models(), max_attempts: int = 3, retry_after: float = 60.0) -> bool:
    """One attempt at the pending chunks whose time has come, from the settled id on; false when there are none."""
    since = store.settled()[0]
    return index_pending(store, models, False, since, max_attempts=max_attempts, retry_after=retry_after)


def ingest(docs: DataFrame, store: Store, models: Models = Models(), *args, **options) -> DataFrame:
    """The statistics of ``ingest_batch`` alone."""
    return ingest_batch(docs, store, models, *args, **options)[0]


def batch_report(added: DataFrame, store: Store, since: int = 0) -> DataFrame:
    """The chunks of a batch with their status, for the load report and the failure list.

    Ids are given in order, so of the log only what concerns ids from ``since`` on is read.
    """
    return with_status(added, store.chunk_status.filter(F.col("chunk_id") >= since))


def batch_stats(report: DataFrame, store: Store) -> DataFrame:
    """One row: what the batch stored, and the totals of the whole store, of which only the part that is not settled is read."""
    stored, complete, failed = store.settle()
    totals = {"total_chunks": stored, "total_complete": complete, "total_failed": failed}
    return batch_counts(report).select("*", *(F.lit(value).cast("long").alias(name) for name, value in totals.items()))
