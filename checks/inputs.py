"""The operators' inputs, derived from the whole of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorekeep import schemas
from lorekeep.operators.models import embed
from lorekeep.sources.rpc import with_parameters
from lorekeep.sources.tables import read_table

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents for work that outweighs reading them."""
    return read_table(spark, f"{folder}/documents.parquet", spread_by="doc_id")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as ``doc_key, source, text``."""
    rows = documents(spark, folder)
    return rows.select(F.col("doc_id").cast("string").alias("doc_key"), "source", "text")


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as markdown: sentences under headings, between rules or in and out of fences; texts with a long fence, one
    that is never closed, or as a table."""
    text, sentence = F.col("text"), F.lit(". ")
    between = lambda mark: F.replace(text, sentence, F.lit(mark))
    texts = [
        between(".\n## "),
        between(".\n-----\n"),
        between(".\n===\n"),
        between(".\n```\n"),
        F.concat(text, F.lit("\n```\n"), text, F.lit("\n```\n\n"), text),
        F.concat(text, F.lit("\n```\n"), text),
        F.replace(between(".\n\n"), F.lit(" "), F.lit(" | ")),
    ]
    kind = F.col("doc_id") % len(texts)
    chosen = F.when(kind == 0, texts[0])
    for number, marked in enumerate(texts[1:], 1):
        chosen = chosen.when(kind == number, marked)
    rows = documents(spark, folder)
    return rows.select(F.col("doc_id").cast("string").alias("doc_key"), "source", chosen.alias("text"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Ten vectors per chunk: ``question_id, chunk_id, embedding``."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("question_id"), F.expr("vec_id div 10").alias("chunk_id"), "embedding"
    )


def label_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One query per label: the mean of its vectors, averaged dimension by dimension."""
    cells = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("place", "value"))
    means = cells.groupBy("label", "place").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    # As many rows per label as the vectors have dimensions.
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("place", "mean"))).alias("_cells"))
    return rows.select(
        F.col("label").cast("long").alias("query_id"),
        F.transform("_cells", lambda cell: cell["mean"]).alias("embedding"),
    )


def tool_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Five summaries per tool: ``tool, ordinal, summary, embedding``."""
    return table(spark, folder, "embeddings").select(
        F.format_string("tool_%d", F.expr("vec_id div 5")).alias("tool"),
        F.expr("cast(vec_id % 5 as int)").alias("ordinal"),
        F.concat(F.lit("summary "), F.col("vec_id").cast("string")).alias("summary"),
        "embedding",
    )


def document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as one chunk with one vector: ``question_id, chunk_id, embedding``."""
    rows = documents(spark, folder).select(
        F.col("doc_id").alias("question_id"), F.col("doc_id").alias("chunk_id"), "text"
    )
    return embed(rows, "text", keep=["question_id", "chunk_id"])


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text")


def benchmark_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").withColumnRenamed("text", "content")


def _kinds(*texts: Column) -> Column:
    """One of the texts by event number."""
    kind = F.col("event_id") % len(texts)
    chosen = F.when(kind == 0, texts[0])
    for number, text in enumerate(texts[1:], 1):
        chosen = chosen.when(kind == number, text)
    return chosen


def tool_messages(spark: SparkSession, folder: str) -> DataFrame:
    """A log of tool calls, well-formed and broken: a conversation per user, a turn per event."""
    events = read_table(spark, f"{folder}/events.parquet", spread_by="event_id")
    name = F.concat(F.lit('"name": "'), F.col("event_type"), F.lit('"'))
    call = F.concat(F.lit("{"), name, F.lit(', "arguments": '), F.col("props"), F.lit("}"))
    quoted = F.replace("props", F.lit('"'), F.lit('\\"'))
    as_text = F.concat(F.lit("{"), name, F.lit(', "arguments": "'), quoted, F.lit('"}'))
    nameless = F.concat(F.lit('{"arguments": '), F.col("props"), F.lit("}"))
    opened, closed = F.lit("<tool_call>"), F.lit("</tool_call>")
    content = _kinds(
        F.concat(opened, F.lit("\n"), call, F.lit("\n"), closed),
        F.concat(opened, opened, call, closed, closed),
        F.concat(F.lit("Let me see. "), opened, F.lit("call: "), call, F.lit(" now"), closed, F.lit(" Done.")),
        F.concat(opened, nameless, closed),
        F.concat(opened, call),
        F.concat(opened, call, closed, F.lit(" and "), opened, call, closed),
        F.concat(opened, as_text, closed),
        F.concat(opened, F.lit('{"name": '), closed, opened, call, closed),
    )
    role = (
        F.when(F.col("event_type") == "view", "user")
        .when(F.col("event_type") == "error", "tool")
        .otherwise("assistant")
    )
    return events.select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), role.alias("role"), content.alias("content")
    )


def timed_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Events as messages with a timestamp."""
    role = F.when(F.col("event_type") == "view", "user").otherwise("assistant")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), role.alias("role"),
        F.col("props").alias("content"), "ts",
    )


def event_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Tools named after the event types, except ``error``, which stays unregistered."""
    names = table(spark, folder, "events").select(F.col("event_type").alias("name")).distinct()
    schema = (
        F.when(F.col("name") == "click", '{"properties": {"id": {"type": "integer", "description": "Item"}}}')
        .when(
            F.col("name") == "purchase",
            '{"properties": {"k": {"type": "integer"}, "mode": {"type": "string", "description": "How"}}, '
            '"required": ["mode"]}',
        )
        .otherwise('{"properties": {"k": {"type": "integer", "description": "Key"}}, "required": ["k"]}')
    )
    rows = names.filter(F.col("name") != "error").select(
        "name",
        F.concat(F.lit("Tool "), F.col("name")).alias("description"),
        F.lit("local").alias("server"),
        schema.alias("parameters_json"),
    )
    return with_parameters(rows)


def error_log(spark: SparkSession, folder: str) -> DataFrame:
    error = _kinds(
        F.lit("llama_decode returned -1"),
        F.lit("llama_decode returned -1"),
        F.lit("Requested tokens exceed Context window Size"),
        F.concat(F.lit("Tool "), F.col("event_type"), F.lit(" is missing 1 required argument")),
        F.concat(F.lit("invalid params: "), F.col("props")),
    )
    return table(spark, folder, "events").select(
        "event_id",
        (F.col("user_id") % 3 + 1).cast("int").alias("iteration"),
        F.floor(F.col("value") * 1000).cast("long").alias("approx_tokens"),
        F.lit(schemas.CONTEXT_TOKENS).cast("long").alias("n_ctx"),
        error.alias("error"),
    )


def catalog_responses(spark: SparkSession, folder: str) -> DataFrame:
    """A tools/list response per part; every tool is listed twice, the second time in full."""
    name = F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"))
    about = F.when(F.col("p_size") % 3 != 1, F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")))
    size_param = F.struct(
        F.lit("integer").alias("type"), F.concat(F.lit("Up to "), F.col("p_size").cast("string")).alias("description")
    )
    kind_param = F.struct(F.lit("string").alias("type"), F.col("p_type").alias("description"))
    schema = F.struct(
        F.lit("object").alias("type"),
        F.struct(size_param.alias("size"), kind_param.alias("kind")).alias("properties"),
        F.array(F.lit("size")).alias("required"),
    )
    no_schema = F.lit(None).cast(
        "struct<type: string, properties: struct<size: struct<type: string, description: string>, "
        "kind: struct<type: string, description: string>>, required: array<string>>"
    )
    stale = F.struct(name.alias("name"), F.lit("old").alias("description"), no_schema.alias("inputSchema"))
    full = F.struct(
        name.alias("name"), about.alias("description"), F.when(F.col("p_size") % 3 != 0, schema).alias("inputSchema")
    )
    body = F.struct(F.struct(F.array(stale, full).alias("tools")).alias("result"))
    return table(spark, folder, "part").select(F.col("p_brand").alias("server"), F.to_json(body).alias("response"))


def rpc_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Logged tools/call responses of every shape."""
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    response = _kinds(
        F.concat(F.lit('{"id":1,"result":{"content":[{"type":"text","text":'), quoted, F.lit("}]}}")),
        F.concat(F.lit('{"id":1,"result":{"content":[{"type":"image"}]}}')),
        F.concat(F.lit('{"id":1,"result":{"content":'), quoted, F.lit("}}")),
        F.concat(F.lit('{"id":1,"result":{"value":'), quoted, F.lit("}}")),
        F.concat(F.lit('{"id":1,"error":{"code":-1,"message":'), quoted, F.lit("}}")),
        F.concat(F.lit('{"id":1,"error":{"code":-1}}')),
        F.lit(None).cast("string"),
    )
    return table(spark, folder, "events").select("event_id", response.alias("response"))


def status_log(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts for the labelled documents: all start pending, some are completed or fail later."""
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "chunk_id")

    def attempt(rows: DataFrame, number: int, status: str, error: str | None = None) -> DataFrame:
        return rows.select(
            "chunk_id",
            F.lit(number).alias("attempt"),
            F.lit(status).alias("status"),
            F.lit(error).cast("string").alias("error"),
            F.lit(None).cast("array<string>").alias("questions"),
        )

    return (
        attempt(labels, 0, "pending")
        .unionByName(attempt(labels.filter("quality = 1"), 1, "complete"))
        .unionByName(attempt(labels.filter("toxic = 1"), 2, "failed", "model error"))
    )
