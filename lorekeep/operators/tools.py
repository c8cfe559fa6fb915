"""Tool catalog: summaries, selection per query, index and prompt rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorekeep import schemas
from lorekeep.functions import prompts, text as tx, vectors as vx
from lorekeep.operators.models import EmbeddingModel, TextModel, embed, with_answer
from lorekeep.operators.search import top_groups


def cached_summaries(tools: DataFrame, index: DataFrame) -> DataFrame:
    """Tools with the summaries an earlier index holds under their name.

    The name alone decides, so a changed description keeps its old summaries; the description
    itself is the new one.
    """
    known = index.filter(F.size("example_queries") > 0).select(
        "name", F.col("example_queries").alias("summaries")
    )
    return tools.join(known, "name", "left")


def _listed_lines(text: Column, n: int) -> Column:
    lines = F.transform(F.split(text, "\n"), tx.strip)
    return F.slice(F.filter(lines, lambda line: line != ""), 1, n)


def index_tools(
    tools: DataFrame,
    index: DataFrame | None = None,
    summarize_fn: TextModel | None = None,
    embed_fn: EmbeddingModel | None = None,
    n: int = schemas.SUMMARIES_PER_TOOL,
    dim: int = schemas.EMBEDDING_DIM,
) -> DataFrame:
    """``tool, ordinal, summary, embedding``: up to ``n`` vectors per tool.

    Only tools without cached summaries are sent to the model; without a model the description's
    own lines serve. A summary whose vector fails is left out, and a tool without any vector is
    not in the result.
    """
    if index is not None:
        known = cached_summaries(tools, index)
    else:
        known = tools.withColumn("summaries", F.lit(None).cast("array<string>"))
    missing = F.col("summaries").isNull()
    if summarize_fn is None:
        fresh = F.col("description")
    else:
        asked = F.when(
            missing, prompts.tool_summary_prompt(F.col("name"), F.col("description"), n)
        )
        known = with_answer(known, asked, summarize_fn, "_answer")
        fresh = F.col("_answer.text")
    summaries = F.coalesce("summaries", _listed_lines(fresh, n))
    rows = known.select(F.col("name").alias("tool"), F.posexplode(summaries).alias("ordinal", "summary"))
    return embed(rows, "summary", embed_fn, dim=dim).filter(F.col("embedding").isNotNull())


def tool_index(tool_summaries: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per indexed tool, sorted: description, summaries and the norm of each vector.

    A tool has at most as many summaries as the indexing step was asked for.
    """
    entry = F.struct("ordinal", "summary", vx.l2_norm(F.col("embedding")).alias("norm"))
    grouped = tool_summaries.groupBy(F.col("tool").alias("name")).agg(
        F.array_sort(F.collect_list(entry)).alias("_entries")
    )
    stats = F.transform(
        "_entries", lambda e: F.struct(e["summary"].alias("query"), e["norm"].alias("embedding_norm"))
    )
    described = grouped.join(tools.select("name", "description"), "name", "left")
    return described.select(
        "name",
        F.coalesce("description", F.lit("")).alias("description"),
        F.transform("_entries", lambda e: e["summary"]).alias("example_queries"),
        stats.alias("query_stats"),
    ).orderBy("name")


def tool_index_header(tool_summaries: DataFrame) -> DataFrame:
    """One row: indexed tools and vector length, 0 for an empty index."""
    return tool_summaries.agg(
        F.countDistinct("tool").cast("int").alias("num_tools"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("embedding_dim"),
    )


def select_tools(
    queries: DataFrame,
    tool_summaries: DataFrame,
    n: int = 3,
    always: Sequence[str] = (),
    tools: DataFrame | None = None,
    **tuning,
) -> DataFrame:
    """``query_id, rank, tool, similarity, ordinal``: up to ``n`` distinct tools per query.

    The names in ``always`` come first, in order of name; the remaining places go to the other
    tools by their best summary, whose ordinal is given. With ``tools``, only registered tools are
    candidates.
    """
    fixed = sorted(set(always))
    slots = n - len(fixed)
    names = F.array(*[F.lit(name) for name in fixed[:n]]) if fixed else F.array().cast("array<string>")
    first = queries.select(
        F.col("query_id").cast("long").alias("query_id"),
        F.posexplode(names).alias("_place", "tool"),
    ).select(
        "query_id",
        (F.col("_place") + 1).alias("rank"),
        "tool",
        F.lit(None).cast("double").alias("similarity"),
        F.lit(None).cast("int").alias("ordinal"),
    )
    if slots <= 0:
        return first
    candidates = tool_summaries.select("tool", "ordinal", "embedding")
    if fixed:
        candidates = candidates.filter(~F.col("tool").isin(fixed))
    if tools is not None:
        candidates = candidates.join(tools.select(F.col("name").alias("tool")), "tool", "left_semi")
    picked = top_groups(queries, candidates, group="tool", item="ordinal", k=slots, **tuning)
    if not fixed:
        return picked
    return first.unionByName(picked.withColumn("rank", F.col("rank") + len(fixed)))


def matched_summaries(selected: DataFrame, tool_summaries: DataFrame) -> DataFrame:
    """Add the summary that made each tool match."""
    texts = tool_summaries.select("tool", "ordinal", "summary")
    return selected.join(texts, ["tool", "ordinal"], "left")


def selected_definitions(selected: DataFrame, tools: DataFrame) -> DataFrame:
    """Catalog rows of the selected tools, with the rank kept; unknown names fall away."""
    return selected.join(tools.withColumnRenamed("name", "tool"), "tool")


def tool_block(name: Column, description: Column, params: Column, required: Column) -> Column:
    """How one tool is shown in a prompt: parameters and an example call."""
    # The words, marks and indents of all lines below.
    params = F.coalesce(params, F.create_map().cast(schemas.PARAMS))
    required = F.coalesce(required, F.array().cast("array<string>"))
    lines = F.transform(
        F.map_entries(params),
        lambda entry: F.concat(
            F.lit("    "),
            entry["key"],
            F.when(F.array_contains(required, entry["key"]), " (required)").otherwise(""),
            F.lit(": "),
            F.coalesce(entry["value"]["description"], F.lit("")),
        ),
    )
    needed = F.filter(F.map_keys(params), lambda key: F.array_contains(required, key))
    arguments = F.array_join(
        F.transform(
            needed,
            lambda key: F.concat(
                F.lit("    "),
                tx.json_string(key),
                F.lit(": "),
                tx.json_string(F.concat(F.lit("<"), key, F.lit("_value>"))),
            ),
        ),
        ",\n",
    )
    example = F.concat(
        F.lit('{\n  "name": '),
        tx.json_string(name),
        F.lit(',\n  "arguments": {'),
        F.when(F.size(needed) > 0, F.concat(F.lit("\n"), arguments, F.lit("\n  "))).otherwise(""),
        F.lit("}\n}"),
    )
    return F.concat(
        F.lit("\n"),
        name,
        F.lit(": "),
        description,
        F.lit("\n  Parameters:\n"),
        F.array_join(lines, "\n"),
        F.lit("\n  \n  Example usage:\n  <tool_call>\n"),
        example,
        F.lit("\n  </tool_call>"),
    )


def _joined_blocks(order: str) -> Column:
    listed = F.array_sort(F.collect_list(F.struct(order, "_block")))
    return F.array_join(F.transform(listed, lambda entry: entry["_block"]), "\n")


def render_tool_prompt(
    selected: DataFrame,
    tools: DataFrame,
    base: str,
    queries: DataFrame | None = None,
    closing: str = prompts.TOOL_PROMPT_CLOSING,
) -> DataFrame:
    """``query_id, prompt``: the base message with the selected tools of each query.

    With ``queries``, every one of them has a row, and ``whole_catalog`` tells those without any selected tool,
    which are shown every tool: their ``prompt`` is null, and the tools' texts are ``catalog_blocks``, kept once
    instead of once per query. With an empty catalog the prompt is the base message alone.
    """
    block = tool_block(F.col("tool"), F.col("description"), F.col("params"), F.col("required"))
    blocks = selected_definitions(selected.select("query_id", "rank", "tool"), tools).select(
        "query_id", "rank", block.alias("_block")
    )

    def message(described: Column) -> Column:
        return F.concat(
            F.lit(base), F.lit("\n\n# Available Tools\n"), described, F.lit("\n\n"), F.lit(closing)
        )

    shown = blocks.groupBy("query_id").agg(_joined_blocks("rank").alias("_tools"))
    if queries is None:
        return shown.select("query_id", message(F.col("_tools")).alias("prompt"))
    any_tool = F.coalesce(tools.limit(1).select(F.lit(True)).scalar(), F.lit(False))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id")).join(shown, "query_id", "left")
    whole = F.col("_tools").isNull() & any_tool
    prompt = F.when(F.col("_tools").isNotNull(), message(F.col("_tools"))).when(~any_tool, F.lit(base))
    return asked.select("query_id", prompt.alias("prompt"), whole.alias("whole_catalog"))


def catalog_blocks(tools: DataFrame) -> DataFrame:
    """``name, block`` of every tool, sorted by name: what a query without a selection is shown between the same
    beginning and end, with a line break after each block but the last."""
    block = tool_block(F.col("name"), F.col("description"), F.col("params"), F.col("required"))
    return tools.select("name", block.alias("block")).orderBy("name")
