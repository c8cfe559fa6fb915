"""Memory calls from messages to stored chunks and answers."""

import json

import pytest

from lorekeep.plans import calls as C, retrieve as rt
from lorekeep.sources.store import open_store

MESSAGES = "conv_id long, turn long, role string, content string"
LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def call(name, **arguments):
    return "<tool_call>" + json.dumps({"name": name, "arguments": arguments}) + "</tool_call>"


@pytest.fixture
def store(spark, tmp_path):
    return open_store(spark, str(tmp_path / "store"))


def answers(df):
    return {(r.conv_id, r.turn, r.ordinal): r.answer for r in df.collect()}


def test_from_messages_to_chunks_and_answers(spark, store):
    keep = lambda topic: call("store_memory", information=f"{topic} {LINE} about {topic}", context="pets")
    rows = [
        (7, 1, "assistant", keep("cats") + " and " + keep("dogs")),
        (-3, 9, "assistant", keep("dogs")),
        (7, 2, "assistant", call("retrieve_memory", query="dogs about dogs", max_results=1)),
        (8, 1, "assistant", call("retrieve_memory", query="cats", max_results=1_000_000)),
        (8, 2, "assistant", call("retrieve_memory", query="cats") + call("other_tool", x=1)),
        (9, 1, "assistant", call("store_memory", context="nothing to keep")),
        (9, 2, "user", "no call"),
    ]
    got = answers(C.answer_messages(spark.createDataFrame(rows, MESSAGES), store))
    assert set(got) == {(7, 1, 0), (7, 1, 1), (-3, 9, 0), (7, 2, 0), (8, 1, 0), (8, 2, 0), (9, 1, 0)}
    # The calls count in order of conversation, turn and ordinal, negative numbers first.
    assert got[-3, 9, 0] == got[7, 1, 0] == "Stored 1 new chunk in memory successfully."
    assert got[7, 1, 1].startswith("Information NOT stored") and got[9, 1, 0].startswith("Information NOT stored")
    assert store.chunks.count() == 2 and store.questions.count() >= 2
    assert got[7, 2, 0].startswith("1. pets: dogs") and "\n2. " not in got[7, 2, 0]
    assert "\n2. " in got[8, 1, 0] and got[8, 1, 0].startswith("1. pets: cats")
    # A second run stores nothing new and finds the same.
    again = answers(C.answer_messages(spark.createDataFrame(rows, MESSAGES), store))
    assert again[7, 1, 0].startswith("Information NOT stored") and again[7, 2, 0] == got[7, 2, 0]


def test_without_calls(spark, store):
    none = spark.createDataFrame([(1, 1, "user", "hello")], MESSAGES)
    got = C.answer_messages(none, store)
    assert got.columns == ["conv_id", "turn", "ordinal", "name", "answer"] and got.collect() == []


def test_a_call_for_very_many_leaves_the_others_alone(spark, store, monkeypatch):
    C.answer_messages(spark.createDataFrame([(1, 1, "a", call("store_memory", information=f"cats {LINE}"))], MESSAGES), store)
    asked = []
    retrieve = rt.retrieve
    monkeypatch.setattr(rt, "retrieve", lambda *args, k=3, **options: asked.append(k) or retrieve(*args, k=k, **options))
    rows = [(at, "retrieve_memory", json.dumps({"query": "cats", "max_results": k})) for at, k in enumerate((1, 5, 16, 17, 64, 500_000, 0, -2))]
    calls = spark.createDataFrame(rows, "call_id long, name string, arguments string")
    got = {r.call_id: r.answer for r in rt.answer_retrieve_calls(calls, store.questions, store.chunks).collect()}
    assert asked == [16, 64, 500_000] and len(got) == 8
    assert got[6] == got[7] == "No relevant information found in memory" and got[0] == got[5]
