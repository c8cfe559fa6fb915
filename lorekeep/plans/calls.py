"""The built-in memory tools on calls taken from a message log, from messages to stored chunks and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lorekeep.operators.memory import store_outcome
from lorekeep.operators.toolcalls import extract_tool_calls
from lorekeep.plans.ingest import Models, ingest_batch
from lorekeep.plans.retrieve import RETRIEVE_TOOL, STORE_TOOL, answer_retrieve_calls
from lorekeep.session import materialise
from lorekeep.sources.documents import notes_to_docs
from lorekeep.sources.store import Store

CALL_KEY = ("conv_id", "turn", "ordinal")


def _ordered(name: str) -> Column:
    """A number as text whose order is that of the numbers, negative ones included."""
    return F.lpad(F.hex(F.col(name).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def answer_calls(calls: DataFrame, store: Store, models: Models = Models(), **options) -> DataFrame:
    """``conv_id, turn, ordinal, name, answer`` for the calls of the two memory tools.

    ``calls`` is what ``extract_tool_calls`` gives; other tools' calls are left out. Conversation, turn and ordinal
    name one call. What is to be stored is ingested first, in order of the calls, with ``models`` and the ``options`` of ``ingest_batch``: of
    equal chunks the first call gets it. Then the searches run, and see it. Arguments that cannot be read store
    nothing and find nothing. No calls give no rows.
    """
    tools = calls.filter(F.col("name").isin(RETRIEVE_TOOL, STORE_TOOL)).select(*CALL_KEY, "name", "arguments")
    # Numbers of searches are data from here on.
    tools = materialise(tools.withColumn("call_id", F.monotonically_increasing_id()))
    key = F.concat_ws("-", *[_ordered(name) for name in CALL_KEY])
    arguments = F.from_json("arguments", "information STRING, context STRING")
    to_store = tools.filter(F.col("name") == STORE_TOOL).withColumn("note_id", key)
    told = to_store.select(*CALL_KEY, "name", F.lit(None).cast("string").alias("answer")).limit(0)
    if not to_store.isEmpty():
        notes = to_store.select(
            "note_id", arguments["information"].alias("information"), F.coalesce(arguments["context"], F.lit("")).alias("context")
        )
        docs = notes_to_docs(notes.filter("information IS NOT NULL"))
        report = ingest_batch(docs, store, models, **options)[1]
        counts = report.groupBy(F.col("doc_key").alias("note_id")).agg(F.count("*").alias("stored"))
        told = to_store.join(counts, "note_id", "left").select(
            *CALL_KEY, "name", store_outcome(F.coalesce("stored", F.lit(0))).alias("answer")
        )
    searches = tools.filter(F.col("name") == RETRIEVE_TOOL)
    if searches.isEmpty():
        return told
    found = answer_retrieve_calls(
        searches.select("call_id", "name", "arguments"), store.questions, store.chunks, embed_fn=models.embed, dim=models.dim
    )
    return told.unionByName(searches.join(found, "call_id").select(*CALL_KEY, "name", "answer"))


def answer_messages(messages: DataFrame, store: Store, models: Models = Models(), **options) -> DataFrame:
    """The answers to the memory calls in ``messages`` (``conv_id, turn, content``), structured or written in the text."""
    return answer_calls(extract_tool_calls(messages), store, models, **options)
