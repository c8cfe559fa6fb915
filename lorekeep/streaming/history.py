"""Last messages per conversation, kept message by message."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorekeep import schemas

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# What a message may carry besides its text; kept in the state as one JSON text.
EXTRAS = ("ts", "tool_calls", "tool_call_id", "name")
_OUTPUT = "conv_id LONG, position INT, turn LONG, role STRING, content STRING, extra_json STRING"
_STATE = "turn LONG, role STRING, content STRING, extra STRING"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "true"}


def _last_messages(n: int, idle_ms: int | None) -> StatefulProcessor:
    """State: the last ``n`` messages of a conversation, by turn, until none has come for ``idle_ms``.

    The class is local so that it travels with the query and needs no module on the workers.
    """
    state = _STATE

    class LastMessages(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            # Every batch puts the whole window anew, so all of it ages from the last message on.
            self.kept = handle.getListState("kept", state, idle_ms)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            window = {turn: (turn, *rest) for turn, *rest in self.kept.get()}
            for frame in rows:
                for turn, role, content, extra in zip(frame["turn"], frame["role"], frame["content"], frame["extra_json"]):
                    window[int(turn)] = (int(turn), role, content, extra)
                # A batch may hold much of one conversation; no more than n rows are kept of it.
                for turn in sorted(window)[:-n]:
                    del window[turn]
            kept = [window[turn] for turn in sorted(window)]
            self.kept.put(kept)
            yield pd.DataFrame(
                {
                    "conv_id": [key[0]] * len(kept),
                    "position": range(1, len(kept) + 1),
                    "turn": [row[0] for row in kept],
                    "role": [row[1] for row in kept],
                    "content": [row[2] for row in kept],
                    "extra_json": [row[3] for row in kept],
                }
            )

        def close(self) -> None:
            pass

    return LastMessages()


def _trimmed(n: int):
    """Keeps the last ``n`` messages of every conversation in a batch of rows, before they are moved."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Of a turn that comes twice the later row counts.
            frame = frame.drop_duplicates(["conv_id", "turn"], keep="last")
            yield frame.sort_values("turn").groupby("conv_id", dropna=False).tail(n)

    return run


def history_stream(
    messages: DataFrame, n: int = schemas.HISTORY_MESSAGES, idle_seconds: float | None = None
) -> DataFrame:
    """A stream with the whole window of each conversation that got messages (update mode).

    A conversation without a message for ``idle_seconds`` of processing time leaves the state, and a later message begins a
    window anew; without it every conversation is kept. A trigger that ends when the input does needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off then: state that may expire asks for batches without data for ever. Messages keep their ``ts``, ``tool_calls``, ``tool_call_id`` and ``name``, where the input has them.

    Needs the RocksDB state store. The window after the last batch equals ``history_window`` of what was not forgotten.
    """
    if idle_seconds is not None and idle_seconds <= 0:
        raise ValueError("idle_seconds must be above 0")
    idle_ms = None if idle_seconds is None else max(1, round(idle_seconds * 1000))
    extras = [name for name in EXTRAS if name in messages.columns]
    extra = F.to_json(F.struct(*extras), _JSON) if extras else F.lit(None).cast("string")
    talk = messages.filter("role <> 'system'").select("conv_id", "turn", "role", "content", extra.alias("extra_json"))
    windows = talk.mapInPandas(_trimmed(n), talk.schema).groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=_last_messages(n, idle_ms),
        outputStructType=_OUTPUT,
        outputMode="Update",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
    if extras:
        kept = T.StructType([messages.schema[name] for name in extras])
        windows = windows.withColumn("extra_json", F.from_json("extra_json", kept, _JSON))
    return windows.select("conv_id", "position", "turn", "role", "content", *[F.col(f"extra_json.{name}") for name in extras])
