"""The registered queries."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks import inputs
from lorekeep.functions import prompts, records, text as tx, vectors as vx
from lorekeep.operators import chunking, conversations as cv, dedup, memory, models, search, toolcalls, tools, vector_index
from lorekeep.plans import calls as tool_answers, ingest as ing, retrieve as rt
from lorekeep.session import scratch_path
from lorekeep.sources import rpc
from lorekeep.sources.conversations import write_conversations
from lorekeep.sources.documents import notes_to_docs, read_markdown, write_text_files
from lorekeep.sources.store import clear_store, open_store
from lorekeep.sources.tool_index import read_saved_index, read_tool_index, write_keyed_index, write_tool_index
from lorekeep.streaming import history
from lorekeep.streaming.ingest import ingest_stream as stream_ingest

Query = Callable[[SparkSession, str], DataFrame]


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as LONG, so that both engines give the same types."""
    return df.select(
        [
            F.col(field.name).cast("long") if isinstance(field.dataType, T.IntegralType) else F.col(field.name)
            for field in df.schema.fields
        ]
    )


def _doc(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_key").cast("long"))


# Documents and chunks ---------------------------------------------------------------------------


def _chunks(spark, folder):
    return chunking.chunk_documents(inputs.docs(spark, folder))


def chunk_documents(spark, folder):
    return _doc(_chunks(spark, folder)).select(
        "doc_id", "pos", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "length", "hash"
    )


def sub_chunks(spark, folder):
    return _doc(chunking.sub_chunks(inputs.docs(spark, folder))).select(
        "doc_id", "pos", F.col("start").alias("start_at"), F.col("end").alias("end_at"), tx.content_hash(F.col("text")).alias("hash")
    )


def chunk_markdown(spark, folder):
    """Chunks of texts with fences, headings, rules and tables."""
    cut = chunking.chunk_documents(inputs.markdown(spark, folder))
    return _doc(cut).select("doc_id", "pos", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "length", "hash")


def dedup_chunks(spark, folder):
    return _doc(dedup.dedup_chunks(_chunks(spark, folder))).select("doc_id", "pos", "source", "length", "hash")


def dedup_against_store(spark, folder):
    """Labelled documents were stored before; all documents are ingested again."""
    stored = inputs.docs(spark, folder).join(
        inputs.table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("doc_key")),
        "doc_key",
        "left_semi",
    )
    known = chunking.chunk_documents(stored)
    return _doc(dedup.dedup_chunks(_chunks(spark, folder), known)).select("doc_id", "pos", "source", "hash")


def chunk_ids(spark, folder):
    numbered = dedup.assign_ids(dedup.dedup_chunks(_chunks(spark, folder)), next_id=100)
    return _doc(numbered).select("chunk_id", "doc_id", "pos", "hash")


def notes_as_docs(spark, folder):
    notes = inputs.table(spark, folder, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("note_id"),
        F.col("text").alias("information"),
        F.when(F.col("role") == "user", "").otherwise(F.col("role")).alias("context"),
    )
    return notes_to_docs(notes)


# Search -----------------------------------------------------------------------------------------


def _rounded(df: DataFrame, name: str = "similarity") -> DataFrame:
    return df.withColumn(name, F.round(name, 6))


def search_topk_exact(spark, folder):
    return _rounded(search.search_chunks(inputs.label_queries(spark, folder), inputs.vectors(spark, folder)))


def search_topk_capped(spark, folder):
    found = search.search_chunks(inputs.label_queries(spark, folder), inputs.vectors(spark, folder), k=3, cap=2)
    return _rounded(found)


def search_in_cells(spark, folder):
    """The plan for query sets too large to broadcast."""
    found = search.search_chunks(
        inputs.label_queries(spark, folder),
        inputs.vectors(spark, folder),
        broadcast_queries=0,
        broadcast_vectors=0,
        cell_queries=4,
        cell_vectors=256,
    )
    return _rounded(found)


def lsh_topk(spark, folder):
    found = search.search_chunks(inputs.label_queries(spark, folder), inputs.vectors(spark, folder), method="lsh")
    return _rounded(found)


def search_few_vectors(spark, folder):
    """The plan for few vectors and a query set too large to broadcast."""
    found = search.search_chunks(inputs.label_queries(spark, folder), inputs.vectors(spark, folder), broadcast_queries=0)
    return _rounded(found)


def _stored_cells(spark, folder):
    path = scratch_path(spark, "cells")
    search.write_cells(inputs.vectors(spark, folder), path, file_rows=500)
    return spark.read.parquet(path)


def lsh_stored_cells(spark, folder):
    """Vectors stored by cell and read back; queries meet them by an equi-join on the cell."""
    found = search.search_chunks(
        inputs.label_queries(spark, folder), _stored_cells(spark, folder), method="lsh", broadcast_queries=0,
        cell_queries=4, cell_vectors=64,
    )
    return _rounded(found)


def lsh_recall(spark, folder):
    """How many of the exact hits the search in cells finds, by query."""
    exact = search.search_chunks(inputs.label_queries(spark, folder), inputs.vectors(spark, folder))
    near = search.search_chunks(inputs.label_queries(spark, folder), inputs.vectors(spark, folder), method="lsh")
    near = near.select("query_id", "chunk_id", F.lit(1).alias("found"))
    both = exact.select("query_id", "chunk_id").join(near, ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("hits"), F.count("found").alias("found"))


def search_many_queries(spark, folder):
    """25 queries from every vector, each turned by some places, over all vectors, which stay where they are."""
    turned = F.concat(F.expr("slice(embedding, turn + 1, size(embedding))"), F.expr("slice(embedding, 1, turn)"))
    asked = inputs.table(spark, folder, "embeddings").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(24))))
    asked = asked.select(F.expr("vec_id * 25 + turn").alias("query_id"), turned.alias("embedding"))
    found = search.search_chunks(asked, inputs.vectors(spark, folder), k=1, broadcast_queries=0, broadcast_vectors=0, cell_queries=4096)
    return _rounded(found)


def index_recall(spark, folder):
    """A trained index against exact search: whether it finds nine tenths of the hits and fetches a tenth of the vectors.

    The queries are the labels' means; these vectors have no clusters, so every cell's codes are read.
    """
    held, asked, path = inputs.vectors(spark, folder), inputs.label_queries(spark, folder), scratch_path(spark, "index")
    index = vector_index.write_index(held, path)
    most = held.count() // 10
    near = vector_index.search_index(asked, path, index, 3, probes=len(index.centres), candidates=most)
    near = near.select("query_id", "chunk_id", F.lit(1).alias("found"))
    both = search.search_chunks(asked, held).select("query_id", "chunk_id").join(near, ["query_id", "chunk_id"], "left")
    return both.agg(
        F.count("*").alias("hits"), F.lit(most).alias("fetched"), (F.count("found") >= F.lit(0.9) * F.count("*")).alias("recalled")
    )


def retrieve_with_text(spark, folder):
    hits = search.search_chunks(inputs.label_queries(spark, folder), inputs.vectors(spark, folder))
    return _rounded(search.attach_text(hits, inputs.document_chunks(spark, folder)))


def retrieve_metadata_missing(spark, folder):
    """Sources come from the labelled documents only; the others are unknown."""
    hits = search.search_chunks(inputs.label_queries(spark, folder), inputs.vectors(spark, folder), k=5)
    chunks = inputs.document_chunks(spark, folder)
    known = memory.without_orphans(
        chunks.drop("text"), inputs.table(spark, folder, "labels").withColumnRenamed("doc_id", "chunk_id")
    )
    return _rounded(search.attach_text(hits, chunks, known)).drop("text")


def render_results(spark, folder):
    """Every label is asked, and as many queries without hits; the hits of odd chunks have lost their text."""
    queries = inputs.label_queries(spark, folder)
    hits = search.search_chunks(queries, inputs.vectors(spark, folder))
    chunks = inputs.document_chunks(spark, folder)
    chunks = chunks.withColumn("text", F.when(F.expr("chunk_id % 2 = 0"), F.col("text")).otherwise(""))
    more = queries.select("query_id").unionByName(queries.select((F.col("query_id") + 1000).alias("query_id")))
    return search.render_results(search.attach_text(hits, chunks), more)


def hash_embed(spark, folder):
    rows = models.embed(inputs.documents(spark, folder), keep=["doc_id"])
    cells = rows.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
    return cells.filter("weight <> 0").select("doc_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight"))


def vector_functions(spark, folder):
    """Norm, cosine with the label's mean vector, and distance."""
    means = inputs.label_queries(spark, folder).select(F.col("query_id").alias("label"), F.col("embedding").alias("mean"))
    joined = inputs.table(spark, folder, "embeddings").join(means, "label")
    cosine = vx.cosine_similarity(F.col("embedding"), F.col("mean"))
    return joined.select(
        "vec_id",
        F.round(vx.l2_norm(F.col("embedding")), 6).alias("norm"),
        F.round(cosine, 6).alias("cosine"),
        F.round(vx.similarity_from_distance(F.lit(1.0) - cosine), 6).alias("from_distance"),
    )


def text_search(spark, folder):
    queries = models.embed(inputs.benchmark_queries(spark, folder), keep=["query_id"])
    return _rounded(search.search_chunks(queries, inputs.document_vectors(spark, folder)))


def expand_queries(spark, folder):
    """Part names are short requests, benchmark texts long ones; each has a longer or shorter form."""
    parts = inputs.table(spark, folder, "part")
    short = parts.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    long = inputs.table(spark, folder, "benchmark").select((-F.col("item_id") - 1).alias("query_id"), "text")
    offered = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" of type "), "p_type")).otherwise("x")
    forms = parts.select(F.col("p_partkey").alias("query_id"), offered.alias("expansion")).unionByName(
        long.select("query_id", F.concat("text", F.lit(" and more")).alias("expansion"))
    )
    return models.expand_queries(short.unionByName(long), expansions=forms)


# Statements and models --------------------------------------------------------------------------


def parse_statements(spark, folder):
    rows = inputs.documents(spark, folder).select(
        "doc_id", tx.parse_statements(F.col("text"), 3).alias("_found")
    )
    return rows.select(
        "doc_id",
        F.size("_found").alias("statements"),
        (F.size("_found") == 0).alias("parse_failed"),
        F.array_join("_found", "\n").alias("joined"),
    )


def summary_quality(spark, folder):
    rows = inputs.table(spark, folder, "documents").select("doc_id", F.col("text"))
    return rows.select(
        "doc_id", tx.word_count(F.col("text")).alias("words"), tx.summary_quality(F.col("text")).alias("quality")
    )


def extractive_summaries(spark, folder):
    return _summaries(spark, folder)


def _summaries(spark, folder, fn=None):
    done = models.summarize_chunks(_chunks(spark, folder), fn)
    return _doc(done).select(
        "doc_id", "pos", F.size("questions").alias("questions"), F.array_join("questions", "\n").alias("joined"), "error"
    )


def question_vectors(spark, folder):
    """Statements of each chunk with their ids and vector norms."""
    chunks = _chunks(spark, folder).withColumn("chunk_id", F.col("doc_key").cast("long") * 1000 + F.col("pos"))
    rows = models.explode_questions(models.index_chunks(chunks))
    return rows.select(
        "question_id", "chunk_id", "ordinal", "question", F.round(vx.l2_norm(F.col("embedding")), 6).alias("norm")
    )


def summary_prompts(spark, folder):
    rows = inputs.table(spark, folder, "documents")
    prompt = prompts.summary_prompt(F.col("text"), 2)
    return rows.select("doc_id", F.md5(prompt).alias("prompt_hash"), F.char_length(prompt).alias("prompt_chars"))


def truncated_answers(spark, folder):
    cut = tx.truncated(F.col("text"), 8000, prompts.TRUNCATION_MARKER)
    rows = inputs.table(spark, folder, "documents")
    return rows.select("doc_id", F.md5(cut).alias("hash"), F.char_length(cut).alias("chars"))


MODEL_LIMIT = 1000


def _bracketing(asked: list[str]) -> list[str]:
    """A stand-in model: fails on a long prompt, else puts the draft in brackets."""
    if any(len(prompt) > MODEL_LIMIT for prompt in asked):
        raise ValueError("prompt too long")
    return [f"[{prompt.rsplit('Draft:\n', 1)[-1].removesuffix('\n\nAnswer:')}]" for prompt in asked]


def refine_answers(spark, folder):
    """Answers refined by a model that fails on long prompts, where the answer stays."""
    rows = inputs.messages(spark, folder).filter("role = 'assistant'")
    asked = rows.select("conv_id", "turn", F.lit("Why?").alias("question"), F.col("content").alias("answer"))
    done = models.refine_answers(asked, _bracketing)
    return done.select("conv_id", "turn", "refined")


# Store --------------------------------------------------------------------------------------------


def _batch(spark, folder) -> DataFrame:
    """Documents as a batch of chunks with status, statements and error."""
    chunks = inputs.documents(spark, folder).withColumnRenamed("doc_id", "chunk_id")
    done = models.summarize(chunks, n=2)
    return done.select(
        "chunk_id",
        "source",
        F.when(F.col("error").isNull(), "complete").otherwise("failed").alias("status"),
        "error",
        F.col("summaries").alias("questions"),
    )


def memory_stats(spark, folder):
    return memory.memory_stats(inputs.document_chunks(spark, folder))


def distinct_sources(spark, folder):
    return memory.distinct_sources(inputs.document_chunks(spark, folder))


def list_by_source(spark, folder):
    return memory.count_by_source(inputs.document_chunks(spark, folder))


def list_filtered(spark, folder):
    found = memory.list_chunks(inputs.document_chunks(spark, folder), source="src", file="1")
    return found.select("chunk_id", "source", F.char_length("text").alias("length"))


def preview(spark, folder):
    return memory.list_chunks(inputs.document_chunks(spark, folder), preview=200).select("chunk_id", "preview")


def find_by_text(spark, folder):
    """Each document is asked for by a text, its own or another; found by hash."""
    rows = inputs.table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"), tx.content_hash(F.col("text")).alias("hash"),
        F.when(F.expr("doc_id % 2 = 0"), F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("asked"),
    )
    return memory.find_by_text(rows, F.col("asked")).select("chunk_id", "hash")


def load_report(spark, folder):
    return _rounded(memory.load_report(_batch(spark, folder)), "success_rate")


def load_total(spark, folder):
    return _rounded(memory.load_total(memory.load_report(_batch(spark, folder))), "success_rate")


def ingest_stats(spark, folder):
    """The batch is what the labelled documents give; the store holds all of them."""
    whole = _batch(spark, folder)
    labels = inputs.table(spark, folder, "labels").select(F.col("doc_id").alias("chunk_id"))
    return memory.ingest_stats(whole.join(labels, "chunk_id", "left_semi"), whole)


def failures(spark, folder):
    return memory.failures(_batch(spark, folder))


def status_latest(spark, folder):
    return memory.latest_status(inputs.status_log(spark, folder)).drop("questions")


def status_backfilled(spark, folder):
    chunks = inputs.document_chunks(spark, folder).drop("text")
    rows = memory.with_status(chunks, inputs.status_log(spark, folder))
    return rows.groupBy("source", "status").agg(F.count("*").alias("chunks"))


def pending_chunks(spark, folder):
    chunks = inputs.document_chunks(spark, folder).drop("text")
    return memory.by_status(chunks, inputs.status_log(spark, folder)).select("chunk_id", "source", "attempt")


def orphans(spark, folder):
    payload = inputs.table(spark, folder, "labels").withColumnRenamed("doc_id", "chunk_id")
    return memory.orphans(inputs.document_chunks(spark, folder).drop("text"), payload)


def without_orphans(spark, folder):
    payload = inputs.table(spark, folder, "labels").withColumnRenamed("doc_id", "chunk_id")
    return memory.without_orphans(inputs.document_chunks(spark, folder).drop("text"), payload)


def _stored(store) -> DataFrame:
    """What a store holds per chunk: metadata, text by id, status and vectors."""
    rows = memory.with_status(store.metadata(), store.chunk_status)
    texts = store.chunk_texts(store.metadata().select("chunk_id"))
    vectors = store.questions.groupBy("chunk_id").agg(F.count("embedding").alias("vectors"))
    joined = rows.join(texts, "chunk_id").join(vectors, "chunk_id", "left")
    return joined.select(
        "chunk_id",
        "source",
        "length",
        "hash",
        tx.content_hash(F.col("text")).alias("text_hash"),
        "status",
        "attempt",
        F.coalesce("vectors", F.lit(0)).alias("vectors"),
    )


def ingest_documents(spark, folder):
    """All documents stored and indexed in a new store, and read back."""
    store = open_store(spark, scratch_path(spark, "store"))
    ing.ingest(inputs.docs(spark, folder), store)
    return _stored(store)


def ingest_twice(spark, folder):
    """Two overlapping batches: the second, of all documents, adds only what the first did not hold."""
    store = open_store(spark, scratch_path(spark, "store"))
    docs = inputs.docs(spark, folder)
    ing.ingest(docs.filter(F.expr("cast(doc_key as long) % 3 < 2")), store)
    ing.ingest(docs, store)
    return _stored(store)


def store_cleared(spark, folder):
    """A store that is cleared and filled again: nothing of before is left, ids start at 0."""
    path = scratch_path(spark, "store")
    docs = inputs.docs(spark, folder)
    ing.ingest(docs.filter(F.expr("cast(doc_key as long) % 3 < 2")), open_store(spark, path))
    store = clear_store(spark, path)
    ing.ingest(docs, store)
    return _stored(store)


def model_stand_in(prompts):
    """One statement a call. Some passages are never answered, some only while two statements are asked for."""
    answers = []
    for prompt in prompts:
        asked = int(prompt.split(" ", 2)[1])
        size = len(prompt.split("Passage:\n", 1)[1]) - len("\n\nStatements:")
        if size % 7 == 0 or (asked == 1 and size % 5 == 0):
            raise RuntimeError("model down")
        answers.append(
            f"The passage has {size} characters and the prompt that came with it asked for {asked} statements about what it says."
        )
    return answers


def summaries_by_model(spark, folder):
    """Statements of a model that answers one at a time, so that every piece is asked again."""
    return _summaries(spark, folder, model_stand_in)


def ingest_failures(spark, folder):
    """All documents stored and indexed with a model that fails on some texts, two attempts each."""
    store = open_store(spark, scratch_path(spark, "store"))
    ing.ingest(inputs.docs(spark, folder), store, ing.Models(model_stand_in), max_attempts=2)
    return _stored(store)


def ingest_report(spark, folder):
    """The load report of a batch, from what ingest gives back."""
    _, report = ing.ingest_batch(inputs.docs(spark, folder), open_store(spark, scratch_path(spark, "store")))
    return _rounded(memory.load_report(report), "success_rate")


def ingest_stream(spark, folder):
    """The same from a stream of documents."""
    schema = inputs.table(spark, folder, "documents").schema
    files = spark.readStream.schema(schema).parquet(f"{folder}/documents.parque[t]")
    docs = files.select(F.col("doc_id").cast("string").alias("doc_key"), "source", "text")
    store = open_store(spark, scratch_path(spark, "store"))
    stream_ingest(docs, store, scratch_path(spark, "progress")).awaitTermination()
    return _stored(store)


# Tools --------------------------------------------------------------------------------------------


def select_tools(spark, folder):
    picked = tools.select_tools(inputs.label_queries(spark, folder), inputs.tool_vectors(spark, folder))
    return _rounded(tools.matched_summaries(picked, inputs.tool_vectors(spark, folder)))


def select_registered_tools(spark, folder):
    """Only tools with an even number are registered."""
    vectors = inputs.tool_vectors(spark, folder)
    names = vectors.select(F.col("tool").alias("name")).distinct()
    registered = names.filter(F.expr("cast(substring(name, 6) as int) % 2 = 0"))
    return _rounded(tools.select_tools(inputs.label_queries(spark, folder), vectors, tools=registered)).drop("ordinal")


ALWAYS = ("tool_7", "tool_3")


def select_tools_slots(spark, folder):
    picked = tools.select_tools(
        inputs.label_queries(spark, folder), inputs.tool_vectors(spark, folder), n=5, always=ALWAYS
    )
    return _rounded(picked).drop("ordinal")


def tool_index_stats(spark, folder):
    vectors = inputs.tool_vectors(spark, folder)
    described = vectors.select(F.col("tool").alias("name"), F.concat(F.lit("About "), "tool").alias("description")).distinct()
    index = tools.tool_index(vectors, described)
    return index.select(
        "name",
        "description",
        F.array_join("example_queries", "|").alias("example_queries"),
        F.round(F.aggregate("query_stats", F.lit(0.0), lambda total, s: total + s["embedding_norm"]), 6).alias("norms"),
    )


def tool_index_saved(spark, folder):
    """The index written as JSON and read back."""
    vectors = inputs.tool_vectors(spark, folder)
    described = vectors.select(F.col("tool").alias("name"), F.concat(F.lit("About "), "tool").alias("description")).distinct()
    path = scratch_path(spark, "index")
    write_tool_index(vectors, described, path)
    return read_saved_index(spark, path).select(
        "name",
        "description",
        F.array_join("example_queries", "|").alias("example_queries"),
        F.round(F.aggregate("query_stats", F.lit(0.0), lambda total, s: total + s["embedding_norm"]), 6).alias("norms"),
    )


def tool_index_header(spark, folder):
    return tools.tool_index_header(inputs.tool_vectors(spark, folder))


def index_tools(spark, folder):
    """Part tools by the lines of their description; tools of one size have cached summaries."""
    catalog = rpc.flatten_catalog(inputs.catalog_responses(spark, folder))
    cached = catalog.filter(F.col("server") == "Brand#2").select(
        "name", F.array(F.lit("cached summary"), F.col("name")).alias("example_queries")
    )
    return tools.index_tools(catalog, cached).select(
        "tool", "ordinal", "summary", F.round(vx.l2_norm(F.col("embedding")), 6).alias("norm")
    )


def catalog_flatten(spark, folder):
    rows = rpc.flatten_catalog(inputs.catalog_responses(spark, folder))
    return rows.select(
        "name",
        "description",
        "server",
        F.array_join(F.map_keys("params"), ",").alias("params"),
        F.array_join("required", ",").alias("required"),
    )


def rpc_result_text(spark, folder):
    return rpc.rpc_result_text(inputs.rpc_responses(spark, folder)).drop("response")


def tool_wire_json(spark, folder):
    rows = rpc.flatten_catalog(inputs.catalog_responses(spark, folder))
    wire = records.tool_json(F.col("name"), F.col("description"), F.col("parameters_json"))
    return rows.select("name", wire.alias("wire"))


def render_tool_prompt(spark, folder):
    """Parts in threes: each three tools make the prompt of one query."""
    name = F.concat(
        "p_brand", F.lit("."), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string")
    )
    selected = inputs.table(spark, folder, "part").select(
        F.expr("p_partkey div 3").alias("query_id"), F.expr("p_partkey % 3 + 1").alias("rank"), name.alias("tool")
    )
    catalog = rpc.flatten_catalog(inputs.catalog_responses(spark, folder))
    return tools.render_tool_prompt(selected, catalog, "You are helpful.")


def render_tool_prompt_all(spark, folder):
    """Every second query has selected a tool; the others are shown the whole catalog."""
    catalog = rpc.flatten_catalog(inputs.catalog_responses(spark, folder))
    name = F.concat(
        "p_brand", F.lit("."), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string")
    )
    parts = inputs.table(spark, folder, "part").select(F.col("p_partkey").alias("query_id"), name.alias("tool"))
    selected = parts.filter("query_id % 2 = 0").withColumn("rank", F.lit(1))
    shown = tools.render_tool_prompt(selected, catalog, "Base.", parts.select("query_id"))
    alone = tools.render_tool_prompt(selected, catalog.limit(0), "Base.", parts.select("query_id"))
    alone = alone.select("query_id", F.col("prompt").alias("without_tools"), F.col("whole_catalog").alias("of_none"))
    size = F.char_length("prompt") > 40
    return shown.select("query_id", size.alias("described"), "whole_catalog").join(alone, "query_id")


def catalog_blocks(spark, folder):
    catalog = rpc.flatten_catalog(inputs.catalog_responses(spark, folder))
    return tools.catalog_blocks(catalog).select("name", tx.content_hash(F.col("block")).alias("hash"))


def failed_listings(spark, folder):
    """Logged answers to tools/list of every shape."""
    rows = inputs.rpc_responses(spark, folder).select(F.col("event_id").cast("string").alias("server"), "response")
    return rpc.failed_listings(rows)


def tool_index_keyed(spark, folder):
    """The index written as objects with tools as keys, and read as such."""
    vectors = inputs.tool_vectors(spark, folder)
    described = vectors.select(F.col("tool").alias("name"), F.concat(F.lit("About "), "tool").alias("description")).distinct()
    path = scratch_path(spark, "keyed")
    write_keyed_index(vectors, described, path)
    return read_tool_index(spark, path, lines=True).select(
        "name",
        "description",
        F.array_join("example_queries", "|").alias("example_queries"),
        F.round(F.aggregate("query_stats", F.lit(0.0), lambda total, s: total + s["embedding_norm"]), 6).alias("norms"),
    )


def markdown_files(spark, folder):
    """Documents written as text files, one per document, and read back."""
    path = scratch_path(spark, "markdown")
    write_text_files(inputs.table(spark, folder, "documents").select("text"), path)
    read = read_markdown(spark, f"{path}/folder=*", pattern="*.txt")
    return read.groupBy(tx.content_hash(F.col("text")).alias("hash"), F.char_length("text").alias("n")).agg(F.count("*").alias("files"))


def extract_structured_calls(spark, folder):
    """Structured calls win over a call written in the text."""
    call = F.struct(
        F.concat(F.lit("id_"), F.col("event_id").cast("string")).alias("id"),
        F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments")).alias("function"),
    )
    listed = F.when(F.expr("event_id % 3 = 0"), F.array(call, call))
    written = F.lit('<tool_call>{"name": "written", "arguments": {}}</tool_call>')
    rows = inputs.table(spark, folder, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.lit("assistant").alias("role"),
        written.alias("content"), listed.alias("tool_calls"),
    )
    return toolcalls.extract_tool_calls(rows)


def validate_undecodable(spark, folder):
    """Arguments with a stray quotation mark before them cannot be read."""
    arguments = F.when(F.expr("event_id % 2 = 0"), F.col("props")).otherwise(F.concat(F.lit('"'), "props"))
    calls = inputs.table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("name"), arguments.alias("arguments")
    )
    checked = toolcalls.validate_calls(calls, inputs.event_catalog(spark, folder))
    return checked.select(
        "event_id", "name", "verdict", F.size("missing").alias("n_missing"), F.col("report").isNull().alias("fine")
    )


def registered_function(spark, folder):
    """A function registered by name, replaced, listed as a tool and called."""
    registry = toolcalls.register({}, "view", lambda k: "old")
    registry = toolcalls.register(registry, "view", lambda k: f"seen {k}")
    schema = {"properties": {"k": {"type": "integer", "description": "Key"}}, "required": ["k"]}
    catalog = toolcalls.tool_row(spark, "view", "Views", schema)
    return toolcalls.execute_calls(_calls(spark, folder).filter("name = 'view'"), registry, catalog).select(
        "conv_id", "turn", "ordinal", "content"
    )


def _calls(spark, folder):
    return toolcalls.extract_tool_calls(inputs.tool_messages(spark, folder))


def extract_tool_calls(spark, folder):
    return toolcalls.extract_tool_calls(inputs.tool_messages(spark, folder), keep_dropped=True)


def incomplete_calls(spark, folder):
    rows = inputs.tool_messages(spark, folder)
    return rows.filter(toolcalls.is_incomplete_call(F.col("content"))).select("conv_id", "turn")


def unknown_tools(spark, folder):
    lost = toolcalls.unknown_tools(_calls(spark, folder), inputs.event_catalog(spark, folder))
    return lost.select("conv_id", "turn", "ordinal", "name", "error")


def validate_calls(spark, folder):
    rows = toolcalls.validate_calls(_calls(spark, folder), inputs.event_catalog(spark, folder))
    return rows.select(
        "conv_id",
        "turn",
        "ordinal",
        "name",
        "verdict",
        F.array_join("invalid", ",").alias("invalid"),
        F.array_join("missing", ",").alias("missing"),
        "report",
    )


def _view(k):
    return k * 2


def _click(id):
    return id


def _purchase(k, mode=None):
    raise ValueError("missing mode")


def _signup(k):
    raise RuntimeError(f"no place for {k}")


REGISTRY = {"view": _view, "click": _click, "purchase": _purchase, "signup": _signup}


def batch_tool_execution(spark, folder):
    return toolcalls.execute_calls(_calls(spark, folder), REGISTRY, inputs.event_catalog(spark, folder))


def batch_retrieve_calls(spark, folder):
    """Each benchmark item is a retrieve call that asks for one to five results."""
    items = inputs.table(spark, folder, "benchmark")
    arguments = F.to_json(F.struct(F.col("text").alias("query"), (F.col("item_id") % 5 + 1).alias("max_results")))
    calls = items.select(F.col("item_id").alias("call_id"), F.lit(rt.RETRIEVE_TOOL).alias("name"), arguments.alias("arguments"))
    return rt.answer_retrieve_calls(calls, inputs.document_vectors(spark, folder), inputs.document_chunks(spark, folder))


def batch_store_calls(spark, folder):
    """Each document is a store call with its language as context."""
    rows = inputs.documents(spark, folder)
    arguments = F.to_json(F.struct(F.col("text").alias("information"), F.col("lang").alias("context")))
    calls = rows.select(F.col("doc_id").alias("call_id"), F.lit(rt.STORE_TOOL).alias("name"), arguments.alias("arguments"))
    stored = spark.createDataFrame([], "hash STRING")
    return rt.answer_store_calls(calls, stored)[1]


def calls_end_to_end(spark, folder):
    """Messages with calls to a new store: each document is to be kept, each benchmark item is looked up."""
    call = lambda name, arguments: F.concat(
        F.lit('<tool_call>{"name": "' + name + '", "arguments": '), F.to_json(F.struct(*arguments)), F.lit("}</tool_call>")
    )
    docs, items = inputs.documents(spark, folder), inputs.table(spark, folder, "benchmark")
    keep = [F.col("text").alias("information"), F.col("lang").alias("context")]
    look = [F.col("text").alias("query"), (F.col("item_id") % 40 + 1).alias("max_results")]
    messages = docs.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), call(rt.STORE_TOOL, keep).alias("content")).unionByName(
        items.select(F.col("item_id").alias("conv_id"), F.lit(2).alias("turn"), call(rt.RETRIEVE_TOOL, look).alias("content"))
    )
    store = open_store(spark, scratch_path(spark, "store"))
    told = tool_answers.answer_messages(messages, store)
    lines = F.when(F.col("name") == rt.RETRIEVE_TOOL, F.col("answer").contains("(relevance: "))
    answer = F.when(F.col("name") == rt.STORE_TOOL, F.col("answer"))
    return told.select("conv_id", "turn", "ordinal", "name", answer.alias("answer"), lines.alias("found"))


def classify_errors(spark, folder):
    rows = toolcalls.classify_errors(inputs.error_log(spark, folder))
    return rows.select("event_id", "kind", toolcalls.classify_tool_errors(F.col("error")).alias("tool_kind"))


# Conversations --------------------------------------------------------------------------------------


def history_window(spark, folder):
    return cv.history_window(inputs.messages(spark, folder), n=4)


def history_reset(spark, folder):
    return cv.reset(inputs.messages(spark, folder))


def prompt_window(spark, folder):
    return cv.prompt_window(inputs.messages(spark, folder), history=5, prompt=3)


def digest(spark, folder):
    return cv.digest(inputs.messages(spark, folder))


def exchange_final_answer(spark, folder):
    return cv.exchanges(inputs.messages(spark, folder))


def exchange_split_turns(spark, folder):
    """Exchanges of the event log, whose conversations reach over many blocks of turns."""
    return cv.exchanges(inputs.tool_messages(spark, folder), block_turns=40)


def iteration_limit(spark, folder):
    return cv.iteration_limit(cv.exchange_ids(inputs.tool_messages(spark, folder)))


def context_usage(spark, folder):
    return _rounded(cv.context_usage(inputs.messages(spark, folder), n_ctx=512), "context_percent")


def export_messages(spark, folder):
    return cv.export_messages(inputs.messages(spark, folder)).select("conv_id", "turn", "role", "content", "wire")


def export_saved(spark, folder):
    """The export written as JSON and read back."""
    path = scratch_path(spark, "export")
    write_conversations(inputs.messages(spark, folder), path, folders=8)
    saved = spark.read.schema("conv_id LONG, turn LONG, role STRING, content STRING, wire STRING").json(path)
    return saved.select("conv_id", "turn", "role", "content", "wire")


def export_timestamps(spark, folder):
    return cv.export_messages(inputs.timed_messages(spark, folder)).select("conv_id", "turn", "role", "timestamp")


def _history_streamed(spark, folder, **options):
    schema = inputs.table(spark, folder, "conversations").schema
    # A pattern, which a stream may be given for a table of one file as for a folder of files.
    files = spark.readStream.schema(schema).parquet(f"{folder}/conversations.parque[t]")
    stream = files.withColumnRenamed("text", "content")
    sink = scratch_path(spark, "history")
    # A stream that ends with its input has no batches without data.
    settings = {
        "spark.sql.streaming.stateStore.providerClass": history.ROCKSDB,
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        query = (
            history.history_stream(stream, n=4, **options)
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{sink}/progress")
            .foreachBatch(
                lambda rows, number: rows.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{sink}/rows")
            )
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    rows = spark.read.parquet(f"{sink}/rows")
    last = rows.groupBy("conv_id").agg(F.max("_batch").alias("_batch"))
    return rows.join(last, ["conv_id", "_batch"], "left_semi").drop("_batch")


def history_stream(spark, folder):
    """The history window kept by a stream over the conversations, after its last batch."""
    return _history_streamed(spark, folder)


def history_stream_idle(spark, folder):
    """The history window kept by a stream whose conversations may be silent for an hour."""
    return _history_streamed(spark, folder, idle_seconds=3600)


_ALL: tuple[Query, ...] = (
    chunk_documents, chunk_markdown, sub_chunks, dedup_chunks, dedup_against_store, chunk_ids, notes_as_docs,
    search_topk_exact, search_topk_capped, search_in_cells, lsh_topk, retrieve_with_text,
    retrieve_metadata_missing, render_results, hash_embed, vector_functions, text_search,
    expand_queries, parse_statements, summary_quality, extractive_summaries, question_vectors,
    summary_prompts, truncated_answers, refine_answers, memory_stats, distinct_sources,
    list_by_source, list_filtered, preview, find_by_text, load_report, load_total, ingest_stats,
    failures, status_latest, status_backfilled, pending_chunks, orphans, without_orphans,
    select_tools, select_tools_slots, tool_index_stats, tool_index_header, index_tools,
    catalog_flatten, rpc_result_text, tool_wire_json, render_tool_prompt, extract_tool_calls,
    incomplete_calls, unknown_tools, validate_calls, batch_tool_execution, batch_retrieve_calls,
    batch_store_calls, calls_end_to_end, classify_errors, history_window, history_reset, prompt_window, digest,
    exchange_final_answer, exchange_split_turns, iteration_limit, context_usage, export_messages, export_timestamps,
    export_saved, ingest_documents, ingest_stream, tool_index_saved,
    history_stream, history_stream_idle, search_few_vectors, search_many_queries, lsh_stored_cells, lsh_recall, index_recall, select_registered_tools,
    render_tool_prompt_all, catalog_blocks, failed_listings, tool_index_keyed, markdown_files,
    extract_structured_calls, validate_undecodable, registered_function, ingest_twice, ingest_report,
    store_cleared, summaries_by_model, ingest_failures,
)


def _registered(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _plain(query(spark, folder))

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


QUERIES: dict[str, Query] = {query.__name__: _registered(query) for query in _ALL}
