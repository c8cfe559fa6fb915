"""Conversation log analytics: windows, digests, exchanges, context usage, export.

``messages`` holds one row per (conv_id, turn). One conversation may be a large part of the log, so
whatever needs all of its rows in order is split into blocks of turns, and only one row per block
is brought together per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorekeep import schemas
from lorekeep.functions.records import iso_timestamp, message_json
from lorekeep.operators.toolcalls import OPEN_TAG

BLOCK_TURNS = 4096
BROADCAST_CONVERSATIONS = 100_000
# The answer at the step limit, and the digest of an empty conversation.
MAX_STEPS_ANSWER = "I've reached the maximum number of steps. Let me summarize what I found..."
NO_MESSAGES = "No messages yet"

_FIRST, _LAST, _HERE = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


def _latest(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows per conversation; each task keeps ``n`` before the shuffle."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= n)


def history_window(messages: DataFrame, n: int = schemas.HISTORY_MESSAGES) -> DataFrame:
    """The last ``n`` messages per conversation, system messages apart, with their ``position``.

    ``orphan_response`` marks a tool message whose call is no longer in the window.
    """
    recent = _latest(messages.filter(F.col("role") != "system"), n)
    within = Window.partitionBy("conv_id")
    position = F.row_number().over(within.orderBy("turn"))
    out = recent.drop("_back").withColumn("position", position)
    if {"tool_calls", "tool_call_id"} <= set(messages.columns):
        # At most n messages per conversation are left here.
        ids = F.transform(F.coalesce("tool_calls", F.array().cast(f"ARRAY<{schemas.TOOL_CALL}>")), lambda c: c["id"])
        called = F.flatten(F.collect_list(ids).over(within))
        orphan = (F.col("role") == "tool") & ~F.array_contains(called, F.col("tool_call_id"))
        out = out.withColumn("orphan_response", F.coalesce(orphan, F.lit(False)))
    return out


def prompt_window(
    messages: DataFrame,
    history: int = schemas.HISTORY_MESSAGES,
    prompt: int = schemas.PROMPT_MESSAGES,
) -> DataFrame:
    """``conv_id, position, role, content``: the latest system message, then the last messages."""
    recent = _latest(messages.filter(F.col("role") != "system"), min(history, prompt)).withColumn(
        "position", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    )
    system = (
        messages.filter(F.col("role") == "system")
        .groupBy("conv_id")
        .agg(F.max_by("content", "turn").alias("content"))
        .select("conv_id", F.lit(0).alias("position"), F.lit("system").alias("role"), "content")
    )
    return system.unionByName(recent.select("conv_id", "position", "role", "content"))


def digest(
    messages: DataFrame, n: int = schemas.DIGEST_MESSAGES, width: int = schemas.DIGEST_WIDTH
) -> DataFrame:
    """``conv_id, digest``: the last ``n`` messages, one shortened line each."""
    talk = F.col("role") != "system"
    # System rows sort behind the others, so that a conversation without messages is still seen.
    newest = Window.partitionBy("conv_id").orderBy(F.when(talk, 0).otherwise(1), F.desc("turn"))
    recent = messages.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= n)
    content = F.coalesce("content", F.lit(""))
    cut = F.when(
        F.char_length(content) > width, F.concat(F.substring(content, 1, width), F.lit("..."))
    ).otherwise(content)
    line = F.concat(F.lit("["), F.upper("role"), F.lit("]: "), cut)
    lines = recent.withColumn("_line", F.when(talk, F.struct("turn", line.alias("line"))))
    grouped = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list("_line")).alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda entry: entry["line"]), "\n")
    return grouped.select(
        "conv_id", F.when(F.size("_lines") == 0, NO_MESSAGES).otherwise(text).alias("digest")
    )


def reset(messages: DataFrame) -> DataFrame:
    """Clear the conversations: only system messages stay."""
    return messages.filter(F.col("role") == "system")


def _is_role(role: str) -> Column:
    return (F.col("role") == role).cast("int")


def _blocked(messages: DataFrame, block_turns: int) -> DataFrame:
    return messages.withColumn("_block", F.expr(f"turn div {int(block_turns)}"))


def _only_long(blocked: DataFrame) -> DataFrame | None:
    """The rows of conversations that reach over more than one block; None when there are none.

    A look at two narrow columns finds those conversations. Where they are few, as they are unless
    most of the log is made of very long ones, their ids are broadcast and nothing else is moved;
    beyond the checked number the join is left to the planner.
    """
    ends = blocked.groupBy("conv_id").agg(F.min("_block").alias("_a"), F.max("_block").alias("_z"))
    long = ends.filter(F.col("_a") < F.col("_z")).select("conv_id")
    ids = long.limit(BROADCAST_CONVERSATIONS + 1).toArrow()
    if ids.num_rows == 0:
        return None
    if ids.num_rows <= BROADCAST_CONVERSATIONS:
        long = F.broadcast(blocked.sparkSession.createDataFrame(ids))
    return blocked.join(long, "conv_id", "left_semi")


def _users_so_far() -> Column:
    """User messages up to this row, within its block."""
    running = Window.partitionBy("conv_id", "_block").orderBy("turn").rowsBetween(_FIRST, _HERE)
    return F.sum(_is_role("user")).over(running)


def exchange_ids(messages: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Add ``exchange``: how many user messages the conversation has seen up to this row."""
    blocked = _blocked(messages, block_turns)
    numbered = blocked.withColumn("_seen", _users_so_far())
    long = _only_long(blocked)
    if long is None:
        return numbered.withColumn("exchange", F.col("_seen")).select(*messages.columns, "exchange")
    per_block = long.groupBy("conv_id", "_block").agg(F.sum(_is_role("user")).alias("_users"))
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(_FIRST, -1)
    offsets = per_block.select("conv_id", "_block", F.sum("_users").over(earlier).alias("_before"))
    offsets = offsets.filter(F.col("_before") > 0)
    joined = numbered.join(offsets, ["conv_id", "_block"], "left")
    exchange = F.coalesce("_before", F.lit(0)) + F.col("_seen")
    return joined.withColumn("exchange", exchange).select(*messages.columns, "exchange")


def _users_in_block() -> Column:
    return F.sum(_is_role("user")).over(Window.partitionBy("conv_id", "_block"))


def _across_blocks(long: DataFrame) -> DataFrame:
    """What each block of a long conversation must know of the others, from one row per block.

    ``_before`` counts earlier user messages. ``_later`` is the answer that later blocks give to the
    exchange left open at the block's end; ``_earlier`` the one that earlier blocks gave to the
    exchange the block begins in. A block's ``_head`` is its last answer ahead of its first user
    message, its ``_tail`` the last one behind its last user message.
    """
    seen = long.withColumns({"_seen": _users_so_far(), "_all": _users_in_block()})
    spoken = F.col("role") == "assistant"

    def last_answer(where: Column) -> Column:
        return F.max_by(F.when(where, F.struct("content")), F.when(where, F.col("turn")))

    ends = seen.groupBy("conv_id", "_block").agg(
        F.sum(_is_role("user")).alias("_users"),
        last_answer(spoken & (F.col("_seen") == 0)).alias("_head"),
        last_answer(spoken & (F.col("_seen") == F.col("_all"))).alias("_tail"),
    )
    ascending = Window.partitionBy("conv_id").orderBy("_block")
    descending = Window.partitionBy("conv_id").orderBy(F.desc("_block"))
    so_far, earlier = ascending.rowsBetween(_FIRST, _HERE), ascending.rowsBetween(_FIRST, -1)
    following = descending.rowsBetween(_FIRST, -1)

    def last_known(answer: str, over) -> Column:
        known = F.when(F.col(answer).isNotNull(), F.struct("_block", F.col(answer).alias("answer")))
        return F.last(known, ignorenulls=True).over(over)

    has_user = F.col("_users") > 0
    ends = ends.withColumns(
        {
            "_before": F.sum("_users").over(earlier),
            "_upto": last_known("_head", so_far),
            "_past": last_known("_tail", earlier),
            "_opened": F.last(F.when(has_user, F.col("_block")), ignorenulls=True).over(earlier),
        }
    )
    # The exchange left open ends in the next block with a user message, else in the last block.
    closing = F.when(has_user, F.struct(F.col("_upto").alias("known")))
    ends = ends.withColumns(
        {
            "_closed": F.last(closing, ignorenulls=True).over(following),
            "_end": F.first("_upto").over(descending.rowsBetween(_FIRST, _HERE)),
        }
    )
    known = F.when(F.col("_closed").isNotNull(), F.col("_closed.known")).otherwise(F.col("_end"))
    later = F.when(known["_block"] > F.col("_block"), known["answer"])
    begun_there = F.col("_opened").isNull() | (F.col("_past._block") >= F.col("_opened"))
    before = F.when(begun_there, F.col("_past.answer"))
    return ends.select("conv_id", "_block", "_before", later.alias("_later"), before.alias("_earlier"))


def exchanges(messages: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Add ``exchange`` and ``final_answer``, the content of the exchange's last assistant message.

    ``content`` is kept as it was. The messages are shuffled once, by conversation and block.
    """
    blocked = _blocked(messages, block_turns)
    segmented = blocked.withColumns({"_seen": _users_so_far(), "_users": _users_in_block()})
    spoken = F.when(F.col("role") == "assistant", F.struct("content"))
    segment = Window.partitionBy("conv_id", "_block", "_seen").orderBy("turn").rowsBetween(_FIRST, _LAST)
    segmented = segmented.withColumn("_own", F.last(spoken, ignorenulls=True).over(segment))
    long = _only_long(blocked)
    if long is None:
        return segmented.select(
            *messages.columns,
            F.col("_seen").alias("exchange"),
            F.col("_own.content").alias("final_answer"),
        )
    joined = segmented.join(_across_blocks(long), ["conv_id", "_block"], "left")
    answer = F.coalesce(
        F.when(F.col("_seen") == F.col("_users"), F.col("_later")),
        F.col("_own"),
        F.when(F.col("_seen") == 0, F.col("_earlier")),
    )
    return joined.select(
        *messages.columns,
        (F.coalesce("_before", F.lit(0)) + F.col("_seen")).alias("exchange"),
        answer["content"].alias("final_answer"),
    )


def _calls_tool(columns: list[str]) -> Column:
    written = F.coalesce(F.col("content").contains(OPEN_TAG), F.lit(False))
    if "tool_calls" not in columns:
        return written
    return written | F.coalesce(F.size("tool_calls") > 0, F.lit(False))


def iteration_limit(exchanged: DataFrame, max_iterations: int = schemas.MAX_ITERATIONS) -> DataFrame:
    """Per exchange: assistant steps, whether the limit was reached without a call-free answer,
    and the fallback answer given then. Input carries ``exchange``."""
    assistant = F.col("role") == "assistant"
    calls = _calls_tool(exchanged.columns)
    grouped = exchanged.groupBy("conv_id", "exchange").agg(
        F.count_if(assistant).alias("iterations"),
        F.count_if(assistant & ~calls).alias("_free"),
    )
    limited = (F.col("iterations") >= max_iterations) & (F.col("_free") == 0)
    return grouped.select(
        "conv_id",
        "exchange",
        "iterations",
        limited.alias("limit_reached"),
        F.when(limited, MAX_STEPS_ANSWER).alias("fallback_answer"),
    )


def context_usage(
    messages: DataFrame,
    n_ctx: int = schemas.CONTEXT_TOKENS,
    pressure: float = schemas.CONTEXT_PRESSURE,
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """Per conversation: characters, estimated tokens, tool traffic and share of the context.

    New content is what follows the last user message; everything up to it is history. Only
    lengths and flags are shuffled, and they are summed per exchange first.
    """
    calls = F.col("tool_calls") if "tool_calls" in messages.columns else F.array().cast("array<string>")
    lean = messages.select(
        "conv_id",
        "turn",
        "role",
        F.char_length(F.coalesce("content", F.lit(""))).cast("long").alias("_chars"),
        ((F.col("role") == "assistant") & F.coalesce(F.size(calls) > 0, F.lit(False))).alias("_calls"),
    )
    reply = (F.col("role") != "user") & (F.col("role") != "system")
    per_exchange = exchange_ids(lean, block_turns).groupBy("conv_id", "exchange").agg(
        F.count("*").alias("messages"),
        F.sum("_chars").alias("chars"),
        F.count_if(reply).alias("replies"),
        F.coalesce(F.sum(F.when(reply, F.col("_chars"))), F.lit(0)).alias("reply_chars"),
        F.count_if(reply & F.col("_calls")).alias("calls"),
        F.count_if(F.col("role") == "tool").alias("responses"),
    )
    fresh = F.max_by(F.struct("replies", "reply_chars", "calls", "responses"), "exchange").alias("new")
    totals = per_exchange.groupBy("conv_id").agg(
        F.sum("messages").alias("messages"), F.sum("chars").alias("total_chars"), fresh
    )
    tokens = lambda chars: F.floor(chars / schemas.CHARS_PER_TOKEN).cast("long")
    out = totals.select(
        "conv_id",
        "messages",
        F.col("new.replies").alias("new_messages"),
        (F.col("total_chars") - F.col("new.reply_chars")).alias("history_chars"),
        F.col("new.reply_chars").alias("new_chars"),
        "total_chars",
        F.col("new.calls").alias("tool_calls"),
        F.col("new.responses").alias("tool_responses"),
    )
    return out.withColumns(
        {
            "history_tokens": tokens(F.col("history_chars")),
            "new_tokens": tokens(F.col("new_chars")),
            "total_tokens": tokens(F.col("total_chars")),
        }
    ).withColumns(
        {
            "context_percent": F.col("total_tokens") * 100.0 / n_ctx,
            "under_pressure": F.col("total_tokens") > n_ctx * pressure,
        }
    )


def export_messages(messages: DataFrame) -> DataFrame:
    """Messages as records for export, with the timestamp in ISO form and the wire JSON."""
    columns = messages.columns
    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    calls = F.to_json("tool_calls").alias("tool_calls") if "tool_calls" in columns else empty("tool_calls", "string")
    return messages.select(
        "conv_id",
        "turn",
        "role",
        "content",
        iso_timestamp(F.col("ts")).alias("timestamp") if "ts" in columns else empty("timestamp", "string"),
        calls,
        *[F.col(name) if name in columns else empty(name, "string") for name in ("tool_call_id", "name")],
        message_json(messages).alias("wire"),
    )
