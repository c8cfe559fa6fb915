import random

import pytest

from lorekeep import schemas
from lorekeep.operators import conversations as cv
from lorekeep.sources.conversations import write_conversations

PLAIN = "conv_id long, turn long, role string, content string"


@pytest.fixture(scope="module")
def log():
    """One long conversation and many short ones."""
    rng = random.Random(4)
    rows = []
    for conv in range(12):
        for turn in range(400 if conv == 0 else rng.randrange(1, 9)):
            role = rng.choices(["user", "assistant", "tool", "system"], [1, 3, 3, 0.3] if conv else [0.3, 1, 9, 0.1])[0]
            rows.append((conv, turn, role, f"{role}-{conv}-{turn}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, few", [(1, 100), (3, 100), (7, 0), (50, 100), (4096, 100)])
def test_exchanges_match_a_plain_walk(spark, log, block, few, monkeypatch):
    monkeypatch.setattr(cv, "BROADCAST_CONVERSATIONS", few)
    expected = {}
    for conv in {row[0] for row in log}:
        exchange, members, answer = 0, {}, {}
        for row in sorted(row for row in log if row[0] == conv):
            exchange += row[2] == "user"
            members[row[1]] = exchange
            if row[2] == "assistant":
                answer[exchange] = row[3]
        expected.update({(conv, turn): (number, answer.get(number)) for turn, number in members.items()})
    frame = spark.createDataFrame(log, PLAIN)
    got = {(r.conv_id, r.turn): (r.exchange, r.final_answer) for r in cv.exchanges(frame, block).collect()}
    assert got == expected
    numbers = {(r.conv_id, r.turn): r.exchange for r in cv.exchange_ids(frame, block).collect()}
    assert numbers == {key: number for key, (number, _) in expected.items()}


def test_windows(spark, rows):
    for size, kept in ((4, [1, 2, 3, 4]), (5, [0, 1, 2, 3, 4]), (9, [0, 1, 2, 3, 4])):
        data = [(1, turn, "user", str(turn)) for turn in range(5)] + [(1, 9, "system", "rules"), (1, 8, "system", "old")]
        got = rows(cv.history_window(spark.createDataFrame(data, PLAIN), size), "turn", "position")
        assert got == [(turn, place) for place, turn in enumerate(kept, 1)]
    prompt = rows(cv.prompt_window(spark.createDataFrame(data, PLAIN), history=4, prompt=2), "position", "role", "content")
    assert prompt == [(0, "system", "rules"), (1, "user", "3"), (2, "user", "4")]
    longer = rows(cv.prompt_window(spark.createDataFrame(data, PLAIN), history=3, prompt=10), "content")
    assert longer == [("2",), ("3",), ("4",), ("rules",)]
    assert rows(cv.reset(spark.createDataFrame(data, PLAIN)), "content") == [("old",), ("rules",)]


def test_a_response_whose_call_was_trimmed_is_marked(spark, rows):
    call = [{"id": "c1", "type": "function", "function": {"name": "f", "arguments": "{}"}}]
    data = [(1, 0, "assistant", "x", None, call, None, None), (1, 1, "tool", "r", None, None, "c1", "f"), (1, 2, "user", "q", None, None, None, None)]
    frame = spark.createDataFrame(data, schemas.MESSAGES)
    assert rows(cv.history_window(frame, 3), "turn", "orphan_response") == [(0, False), (1, False), (2, False)]
    assert rows(cv.history_window(frame, 2), "turn", "orphan_response") == [(1, True), (2, False)]


def test_the_window_is_cut_before_the_shuffle(spark, log):
    plan = cv.history_window(spark.createDataFrame(log, PLAIN), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_digest(spark, rows):
    data = [(1, turn, "user", "x" * (79 + turn)) for turn in range(7)] + [(1, 7, "assistant", None), (2, 0, "system", "s")]
    got = dict(rows(cv.digest(spark.createDataFrame(data, PLAIN))))
    lines = got[1].split("\n")
    assert len(lines) == 5 and lines[-1] == "[ASSISTANT]: "
    assert lines[0] == "[USER]: " + "x" * 80 + "..."
    assert got[2] == "No messages yet"
    short = [(1, 0, "user", "x" * 80)]
    assert rows(cv.digest(spark.createDataFrame(short, PLAIN)), "digest") == [("[USER]: " + "x" * 80,)]


def test_iteration_limit(spark, rows):
    busy = [(1, 0, "user", "q")] + [(1, n, "assistant", "<tool_call>{}</tool_call>") for n in range(1, 6)]
    calm = [(2, 0, "user", "q")] + [(2, n, "assistant", "<tool_call>" if n < 5 else "done") for n in range(1, 6)]
    few = [(3, 0, "user", "q"), (3, 1, "assistant", "<tool_call>")]
    frame = cv.exchange_ids(spark.createDataFrame(busy + calm + few, PLAIN))
    got = rows(cv.iteration_limit(frame), "conv_id", "iterations", "limit_reached", "fallback_answer")
    assert got == [(1, 5, True, cv.MAX_STEPS_ANSWER), (2, 5, False, None), (3, 1, False, None)]


def test_usage(spark):
    call = [{"id": "c", "type": "function", "function": {"name": "f", "arguments": "{}"}}]
    rows = [
        (1, 0, "system", "s" * 10, None, None, None, None),
        (1, 1, "user", "u" * 11, None, None, None, None),
        (1, 2, "assistant", None, None, call, None, None),
        (1, 3, "tool", "t" * 20, None, None, "c", "f"),
        (1, 4, "assistant", "a" * 6, None, None, None, None),
    ]
    row = cv.context_usage(spark.createDataFrame(rows, schemas.MESSAGES), n_ctx=12).first()
    assert (row.history_chars, row.new_chars, row.total_chars) == (21, 26, 47)
    assert (row.history_tokens, row.new_tokens, row.total_tokens) == (5, 6, 11)
    assert (row.tool_calls, row.tool_responses, row.messages, row.new_messages) == (1, 1, 5, 3)
    assert row.context_percent == pytest.approx(1100 / 12) and row.under_pressure


def test_export(spark, tmp_path):
    call = [{"id": "c", "type": "function", "function": {"name": "f", "arguments": "{}"}}]
    frame = spark.createDataFrame(
        [(1, 0, "assistant", "", None, call, None, ""), (2, 0, "tool", "r", None, [], "c", "f")], schemas.MESSAGES
    ).selectExpr("conv_id", "turn", "role", "content", "timestamp'2024-01-02 03:04:05.678' as ts", "tool_calls", "tool_call_id", "name")
    got = {r.conv_id: r for r in cv.export_messages(frame).collect()}
    assert got[1].wire == '{"role":"assistant","tool_calls":[{"id":"c","type":"function","function":{"name":"f","arguments":"{}"}}]}'
    assert got[2].wire == '{"role":"tool","content":"r","tool_call_id":"c","name":"f"}'
    assert got[1].timestamp == "2024-01-02T03:04:05.678000"
    for folders, column in ((None, "conv_id"), (4, "folder")):
        write_conversations(frame, str(tmp_path / column), folders)
        saved = spark.read.json(str(tmp_path / column))
        assert saved.count() == 2 and {column, "conv_id", "wire"} <= set(saved.columns)
