"""Queries against the store, and the two built-in memory tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorekeep import schemas
from lorekeep.operators.chunking import chunk_documents
from lorekeep.operators.dedup import dedup_chunks
from lorekeep.operators.memory import store_outcome
from lorekeep.operators.models import EmbeddingModel, TextModel, embed, expand_queries
from lorekeep.operators.search import attach_text, render_results, search_chunks
from lorekeep.operators.toolcalls import tool_row
from lorekeep.sources.documents import notes_to_docs

# Results up to which calls are searched together.
FEW_RESULTS = 16

# The built-in tools.
RETRIEVE_TOOL = "retrieve_memory"
STORE_TOOL = "store_memory"
MEMORY_TOOL_PARAMETERS = {
    RETRIEVE_TOOL: {
        "type": "object",
        "properties": {
            "query": {"type": "string", "description": "What to look for, in detail"},
            "max_results": {"type": "integer", "description": "How many results to give; 3 if left out"},
        },
        "required": ["query"],
    },
    STORE_TOOL: {
        "type": "object",
        "properties": {
            "information": {"type": "string", "description": "New information to keep"},
            "context": {"type": "string", "description": "What the information is about"},
        },
        "required": ["information"],
    },
}

MEMORY_TOOL_DESCRIPTIONS = {
    RETRIEVE_TOOL: "Search the stored documents for details, examples and instructions.",
    STORE_TOOL: "Keep information that is new and worth remembering.",
}


def memory_tools(spark: SparkSession) -> DataFrame:
    """Catalog rows of the two built-in tools."""
    rows = [
        tool_row(spark, name, MEMORY_TOOL_DESCRIPTIONS[name], parameters)
        for name, parameters in MEMORY_TOOL_PARAMETERS.items()
    ]
    return rows[0].unionByName(rows[1])


def retrieve(
    queries: DataFrame,
    questions: DataFrame,
    chunks: DataFrame,
    k: int = schemas.TOP_CHUNKS,
    embed_fn: EmbeddingModel | None = None,
    expand_fn: TextModel | None = None,
    dim: int = schemas.EMBEDDING_DIM,
    **search,
) -> DataFrame:
    """``query_id, rank, chunk_id, similarity, source, text`` for ``query_id, text`` rows."""
    asked = expand_queries(queries, expand_fn)
    vectors = embed(asked, "search_text", embed_fn, dim=dim, keep=["query_id"])
    return attach_text(search_chunks(vectors, questions, k, **search), chunks)


def answer_retrieve_calls(
    calls: DataFrame, questions: DataFrame, chunks: DataFrame, **options
) -> DataFrame:
    """Tool messages for a table of ``call_id, name, arguments``: all searches run as one job.

    Each call may ask for its own number of results, 3 when it does not. Calls that ask for up to ``FEW_RESULTS`` are searched
    together, and so are those up to four times as many, and so on: one that asks for very many costs the others nothing.
    """
    arguments = F.from_json("arguments", "query STRING, max_results INT")
    asked = calls.filter(F.col("name") == RETRIEVE_TOOL).select(
        F.col("call_id").alias("query_id"),
        arguments["query"].alias("text"),
        F.coalesce(arguments["max_results"], F.lit(schemas.TOP_CHUNKS)).alias("_k"),
    )
    steps = F.ceil(F.log(4.0, F.greatest(F.col("_k"), F.lit(1)) / F.lit(float(FEW_RESULTS))))
    asked = asked.withColumn("_class", F.greatest(steps, F.lit(0)).cast("int"))
    found = None
    # A number for each class, of which there are no more than powers of four.
    for part, most in sorted(map(tuple, asked.groupBy("_class").agg(F.max("_k")).collect())):
        own = asked.filter(F.col("_class") == part)
        hits = retrieve(own.select("query_id", "text"), questions, chunks, k=max(most, 1), **options)
        wanted = hits.join(own.select("query_id", "_k"), "query_id").filter(F.col("rank") <= F.col("_k")).drop("_k")
        found = wanted if found is None else found.unionByName(wanted)
    if found is None:
        found = retrieve(asked.select("query_id", "text"), questions, chunks, **options)
    return render_results(found, asked).withColumnRenamed("query_id", "call_id")


def answer_store_calls(calls: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new chunks, tool messages) for store calls; ``stored`` holds the hashes already known.

    The calls count as made in the order of their id: of equal chunks the first call gets it.
    """
    arguments = F.from_json("arguments", "information STRING, context STRING")
    notes = calls.filter(F.col("name") == STORE_TOOL).select(
        F.col("call_id").alias("note_id"),
        arguments["information"].alias("information"),
        F.coalesce(arguments["context"], F.lit("")).alias("context"),
    )
    docs = notes_to_docs(notes).withColumn("call_id", F.col("doc_key").cast("long"))
    fresh = dedup_chunks(chunk_documents(docs), stored, order=("call_id", "pos"))
    counts = fresh.groupBy("call_id").agg(F.count("*").alias("stored"))
    told = notes.select(F.col("note_id").alias("call_id")).join(counts, "call_id", "left")
    outcome = store_outcome(F.coalesce("stored", F.lit(0)))
    return fresh, told.select("call_id", outcome.alias("answer"))
