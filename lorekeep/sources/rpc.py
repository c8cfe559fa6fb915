"""Logged JSON-RPC responses: tool catalogs and call results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lorekeep import schemas

# Fixed value: the schema of a tool that comes without one.
EMPTY_PARAMETERS = '{"type": "object", "properties": {}}'

_CATALOG = "result STRUCT<tools: ARRAY<STRUCT<name: STRING, description: STRING, inputSchema: STRING>>>"
_PARAMETERS = f"properties {schemas.PARAMS}, required ARRAY<STRING>"


def parameters_of(parameters_json: Column) -> Column:
    """STRUCT<properties, required> of a JSON parameter schema."""
    return F.from_json(parameters_json, _PARAMETERS)


def with_parameters(tools: DataFrame) -> DataFrame:
    """Add ``params`` and ``required``, empty where the schema names none."""
    parsed = tools.withColumn("_schema", parameters_of(F.col("parameters_json")))
    return parsed.withColumns(
        {
            "params": F.coalesce("_schema.properties", F.create_map().cast(schemas.PARAMS)),
            "required": F.coalesce("_schema.required", F.array().cast("array<string>")),
        }
    ).drop("_schema")


def flatten_catalog(responses: DataFrame, namespaced: bool = True) -> DataFrame:
    """The tools in ``server, response`` rows of a tools/list call.

    A tool listed twice by a server keeps its last definition. With ``namespaced``, names and
    descriptions carry the server.
    """
    listed = responses.select(
        "server",
        F.posexplode(F.from_json("response", _CATALOG)["result"]["tools"]).alias("_pos", "_tool"),
    )
    tools = (
        listed.groupBy("server", F.col("_tool.name").alias("name"))
        .agg(F.max_by("_tool", "_pos").alias("_tool"))
        .select(
            "server",
            "name",
            F.coalesce("_tool.description", F.lit("")).alias("description"),
            F.coalesce("_tool.inputSchema", F.lit(EMPTY_PARAMETERS)).alias("parameters_json"),
        )
    )
    if namespaced:
        tools = tools.withColumns(
            {
                "name": F.concat("server", F.lit("."), "name"),
                "description": F.concat(F.lit("[MCP: "), "server", F.lit("] "), "description"),
            }
        )
    return with_parameters(tools).select(
        "name", "description", "server", "params", "required", "parameters_json"
    )


def failed_listings(responses: DataFrame) -> DataFrame:
    """``server, error`` of the tools/list calls in ``server, response`` rows that gave no catalog."""
    outer = F.from_json("response", "result STRUCT<tools: STRING>, error STRING")
    message = F.coalesce(F.from_json(outer["error"], "message STRING")["message"], F.lit("Unknown error"))
    failed = F.concat(F.lit("MCP server '"), F.col("server"), F.lit("' "))
    error = (
        F.when(F.coalesce("response", F.lit("")) == "", F.concat(failed, F.lit("returned no response for tools/list")))
        .when(outer["error"].isNotNull(), F.concat(failed, F.lit("tools/list failed: "), message))
        .when(outer["result"]["tools"].isNull(), F.concat(failed, F.lit("listed no tools")))
    )
    return responses.select("server", error.alias("error")).filter(F.col("error").isNotNull())


def rpc_result_text(responses: DataFrame) -> DataFrame:
    """Add ``text`` and ``is_error`` to rows with a ``response`` of a tools/call.

    The first content item's text; the items as JSON when it has none; the whole result when
    there is no content; else the error message. Nested values are given as JSON text.
    """
    outer = F.from_json("response", "result STRING, error STRING")
    parsed = responses.withColumns({"_result": outer["result"], "_error": outer["error"]})
    parsed = parsed.withColumn("_content", F.from_json("_result", "content STRING")["content"])
    items = F.from_json("_content", "array<struct<text: string>>")
    is_list = F.startswith("_content", F.lit("["))
    content = F.when(is_list, F.coalesce(F.try_element_at(items, F.lit(1))["text"], F.col("_content")))
    found = F.coalesce(content, F.col("_content"), F.col("_result"))
    message = F.coalesce(F.from_json("_error", "message STRING")["message"], F.lit("Unknown error"))
    failed = F.concat(
        F.lit("MCP tool call failed: "),
        F.when(F.col("response").isNull(), "No response").otherwise(message),
    )
    return parsed.withColumns(
        {"text": F.coalesce(found, failed), "is_error": F.col("_result").isNull()}
    ).drop("_result", "_error", "_content")
