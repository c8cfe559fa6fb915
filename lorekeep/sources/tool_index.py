"""Tool index files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lorekeep import schemas
from lorekeep.operators.tools import tool_index, tool_index_header

_ROW = (
    "name STRING, description STRING, example_queries ARRAY<STRING>, "
    "query_stats ARRAY<STRUCT<query: STRING, embedding_norm: DOUBLE>>"
)
_NOTE = "Vectors are not part of this file"


def read_tool_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``name, description, example_queries, query_stats`` from index files with tools as keys.

    A file is one object, or with ``lines`` an object per line. Missing fields become empty; a missing or
    unreadable file gives no rows.
    """
    try:
        files = spark.read.schema(schemas.TOOL_INDEX_FILE).json(path, multiLine=not lines)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ROW)
    rows = files.select(F.explode("tools").alias("name", "tool"))
    return rows.select(
        "name",
        F.coalesce("tool.description", F.lit("")).alias("description"),
        F.coalesce("tool.example_queries", F.array().cast("array<string>")).alias("example_queries"),
        F.col("tool.query_stats").alias("query_stats"),
    )


def write_tool_index(tool_summaries: DataFrame, tools: DataFrame, path: str) -> None:
    """One JSON line per tool under ``tools``, and the header under ``metadata``; no vectors."""
    root = path.rstrip("/")
    tool_index(tool_summaries, tools).write.mode("overwrite").json(f"{root}/tools")
    header = tool_index_header(tool_summaries).withColumn("note", F.lit(_NOTE))
    header.write.mode("overwrite").json(f"{root}/metadata")


def write_keyed_index(tool_summaries: DataFrame, tools: DataFrame, path: str) -> None:
    """The index as objects with ``metadata`` and, under ``tools``, a tool by its name: one tool per line, so that a
    large catalog is written by many tasks. ``read_tool_index(..., lines=True)`` reads it."""
    # One row of two numbers.
    number, width = tool_index_header(tool_summaries).first()
    header = F.struct(
        F.lit(number).alias("num_tools"), F.lit(width).alias("embedding_dim"), F.lit(_NOTE).alias("note")
    )
    entry = F.struct("description", "example_queries", "query_stats")
    objects = F.to_json(F.struct(header.alias("metadata"), F.create_map("name", entry).alias("tools")))
    tool_index(tool_summaries, tools).select(objects.alias("value")).write.mode("overwrite").text(path)


def read_saved_index(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tool_index`` wrote."""
    return spark.read.schema(_ROW).json(f"{path.rstrip('/')}/tools")
