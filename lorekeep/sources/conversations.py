"""Conversation export."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorekeep.operators.conversations import BLOCK_TURNS, export_messages


def write_conversations(
    messages: DataFrame, path: str, folders: int | None = 256, mode: str = "overwrite"
) -> None:
    """Exported messages as JSON lines.

    Conversations are spread over ``folders`` folders by hash, since a folder each would be far too
    many for a large log; ``folders=None`` gives that form for a few conversations. Rows are moved
    by folder and block of turns, so that a folder gets few files and a long conversation several.
    """
    rows = export_messages(messages)
    folder = "conv_id"
    if folders is not None:
        folder = "folder"
        rows = rows.withColumn(folder, F.pmod(F.xxhash64("conv_id"), F.lit(folders)).cast("int"))
    moved = rows.withColumn("_block", F.expr(f"turn div {BLOCK_TURNS}")).repartition(folder, "_block")
    moved.drop("_block").write.mode(mode).partitionBy(folder).json(path)
