import json

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.records import tool_json
from lorekeep.operators import tools as tl
from lorekeep.operators.toolcalls import tool_row
from lorekeep.sources import rpc
from lorekeep.sources.tool_index import read_saved_index, read_tool_index, write_tool_index

QUERIES = "query_id long, embedding array<float>"
SUMMARIES = "tool string, ordinal int, summary string, embedding array<float>"


@pytest.fixture(scope="module")
def summaries(spark):
    return spark.createDataFrame(
        [
            ("near", 0, "n0", [1.0, 0.1]),
            ("near", 1, "n1", [1.0, 0.0]),
            ("far", 0, "f0", [0.0, 1.0]),
            ("mid", 0, "m0", [1.0, 1.0]),
            ("twin", 0, "t0", [2.0, 2.0]),
        ],
        SUMMARIES,
    )


def test_selection_slots_and_order(spark, summaries, rows):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], QUERIES)
    picked = tl.select_tools(queries, summaries, n=3)
    assert rows(picked, "rank", "tool", "ordinal") == [(1, "near", 1), (2, "mid", 0), (3, "twin", 0)]
    assert rows(tl.matched_summaries(picked, summaries), "rank", "summary")[0] == (1, "n1")
    fixed = tl.select_tools(queries, summaries, n=3, always=["zeta", "near"])
    assert rows(fixed, "rank", "tool") == [(1, "near"), (2, "zeta"), (3, "mid")]
    only = tl.select_tools(queries, summaries, n=1, always=["zeta", "near"])
    assert rows(only, "rank", "tool") == [(1, "near")]
    known = spark.createDataFrame([("far",)], "name string")
    assert rows(tl.select_tools(queries, summaries, n=3, tools=known), "tool") == [("far",)]


def test_index_reuses_summaries_by_name(spark, rows):
    catalog = spark.createDataFrame([("a", "new text"), ("b", " one \n\n two \nthree")], "name string, description string")
    index = spark.createDataFrame([("a", ["kept"]), ("b", [])], "name string, example_queries array<string>")
    got = rows(tl.index_tools(catalog, index, n=2), "tool", "ordinal", "summary")
    assert got == [("a", 0, "kept"), ("b", 0, "one"), ("b", 1, "two")]

    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        return ["first\nsecond" for _ in prompts]

    def vectors(texts):
        if "second" in texts:
            raise ValueError("no vector")
        return [[float(len(text))] for text in texts]

    made = tl.index_tools(catalog, index, model, vectors)
    assert rows(made, "tool", "summary", "embedding") == [("a", "kept", [4.0]), ("b", "first", [5.0])]
    assert asked.value == 1


def test_index_files(spark, summaries, rows, tmp_path):
    catalog = spark.createDataFrame([("near", "N")], "name string, description string")
    write_tool_index(summaries, catalog, str(tmp_path / "index"))
    saved = read_saved_index(spark, str(tmp_path / "index"))
    assert rows(saved, "name", "description", "example_queries") == [
        ("far", "", ["f0"]), ("mid", "", ["m0"]), ("near", "N", ["n0", "n1"]), ("twin", "", ["t0"]),
    ]
    header = json.loads(next((tmp_path / "index" / "metadata").glob("*.json")).read_text())
    assert header["num_tools"] == 4 and header["embedding_dim"] == 2
    file = tmp_path / "tool_index.json"
    file.write_text(json.dumps({
        "metadata": {"num_tools": 2, "embedding_dim": 2, "note": "x"},
        "tools": {"t1": {"description": "d", "example_queries": ["q"], "query_stats": [{"query": "q", "embedding_norm": 1.0}]}, "t2": {}},
    }, indent=2))
    assert rows(read_tool_index(spark, str(file)), "name", "description", "example_queries") == [("t1", "d", ["q"]), ("t2", "", [])]
    broken = tmp_path / "broken.json"
    broken.write_text("{nope")
    assert read_tool_index(spark, str(broken)).collect() == []
    assert read_tool_index(spark, str(tmp_path / "none.json")).collect() == []
    empty = tl.tool_index_header(summaries.limit(0)).first()
    assert tuple(empty) == (0, 0)


def test_prompt_rendering(spark, monkeypatch):
    parameters = {"properties": {"q": {"type": "string", "description": "What"}, "n": {"type": "integer"}}, "required": ["q"]}
    catalog = tool_row(spark, "find", "Finds", parameters).unionByName(tool_row(spark, "stop", "Stops", {}))
    selected = spark.createDataFrame([(1, 1, "find"), (1, 2, "lost"), (3, 1, "lost")], "query_id long, rank int, tool string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r.query_id: r.prompt for r in tl.render_tool_prompt(selected, catalog, "Base.", asked, "End.").collect()}
    example = json.dumps({"name": "find", "arguments": {"q": "<q_value>"}}, indent=2)
    block = (
        "\nfind: Finds\n  Parameters:\n    q (required): What\n    n: \n  \n  Example usage:\n  <tool_call>\n"
        f"{example}\n  </tool_call>"
    )
    assert got[1] == f"Base.\n\n# Available Tools\n{block}\n\nEnd."
    # A query without a selection is shown every tool; their texts are kept once.
    flags = tl.render_tool_prompt(selected, catalog, "Base.", asked, "End.").select("query_id", "whole_catalog")
    assert got[2] is None and {tuple(r) for r in flags.collect()} == {(1, False), (2, True)}
    every = tl.catalog_blocks(catalog).collect()
    assert [r.name for r in every] == ["find", "stop"] and every[0].block == block and "stop: Stops" in every[1].block
    nothing = tl.render_tool_prompt(selected, catalog.limit(0), "Base.", asked, "End.").collect()
    assert {r.prompt for r in nothing} == {"Base."}


def test_catalog_and_results(spark, rows):
    listed = {"result": {"tools": [
        {"name": "a", "description": "old"},
        {"name": "a", "description": "new", "inputSchema": {"type": "object", "properties": {"x": {"type": "string", "description": "X"}}, "required": ["x"]}},
        {"name": "b"},
    ]}}
    df = spark.createDataFrame([("s", json.dumps(listed)), ("t", '{"error": {"message": "no"}}')], "server string, response string")
    got = rpc.flatten_catalog(df).orderBy("name").collect()
    assert [(r.name, r.description, r.required) for r in got] == [("s.a", "[MCP: s] new", ["x"]), ("s.b", "[MCP: s] ", [])]
    assert got[0].params["x"].description == "X" and got[1].params == {}
    assert json.loads(got[1].parameters_json) == {"type": "object", "properties": {}}
    wire = rpc.flatten_catalog(df, namespaced=False).select(tool_json(F.col("name"), F.col("description"), F.col("parameters_json")).alias("j"))
    assert json.loads(sorted(r.j for r in wire.collect())[0])["function"]["parameters"]["required"] == ["x"]
    answers = [
        ('{"result": {"content": [{"type": "text", "text": "t"}, {"text": "u"}]}}', "t", False),
        ('{"result": {"content": []}}', "[]", False),
        ('{"result": {"content": "plain"}}', "plain", False),
        ('{"result": {"content": [{"k": 1}]}}', '[{"k":1}]', False),
        ('{"result": {"v": 1}}', '{"v":1}', False),
        ('{"error": {"message": "bad"}}', "MCP tool call failed: bad", True),
        ('{"id": 1}', "MCP tool call failed: Unknown error", True),
        (None, "MCP tool call failed: No response", True),
    ]
    df = spark.createDataFrame([(r, t, e) for r, t, e in answers], "response string, want string, wrong boolean")
    for row in rpc.rpc_result_text(df).collect():
        assert (row.text.replace(" ", ""), row.is_error) == (row.want.replace(" ", ""), row.wrong)


def test_failed_listings(spark, rows):
    from lorekeep.sources.rpc import failed_listings

    answers = [("a", '{"result": {"tools": []}}'), ("b", '{"error": {"message": "down"}}'), ("c", None), ("d", '{"result": {}}'), ("e", '{"error": {}}')]
    found = dict(rows(failed_listings(spark.createDataFrame(answers, "server string, response string")), "server", "error"))
    assert found == {
        "b": "MCP server 'b' tools/list failed: down", "c": "MCP server 'c' returned no response for tools/list",
        "d": "MCP server 'd' listed no tools", "e": "MCP server 'e' tools/list failed: Unknown error",
    }
