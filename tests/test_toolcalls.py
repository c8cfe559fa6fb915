import pytest
from pyspark.sql import functions as F

from lorekeep import schemas
from lorekeep.operators import toolcalls as tc

CALL = '{"name": "f", "arguments": {"a": 1}}'


@pytest.fixture(scope="module")
def calls(spark):
    def extract(content, **options):
        df = spark.createDataFrame([(1, 1, content)], "conv_id long, turn long, content string")
        return [(r.id, r.name, r.arguments, r.outcome) for r in tc.extract_tool_calls(df, **options).collect()]

    return extract


@pytest.mark.parametrize(
    "content, expected",
    [
        (f"<tool_call>{CALL}</tool_call>", [("call_0", "f", '{"a":1}', "parsed")]),
        (f"<tool_call>\n\n{CALL}  \n</tool_call>", [("call_0", "f", '{"a":1}', "parsed")]),
        (f"<tool_call><tool_call>{CALL}</tool_call></tool_call>", [("call_0", "f", '{"a":1}', "parsed")]),
        (f"<tool_call>>>{CALL}</tool_call>", [("call_0", "f", '{"a":1}', "parsed")]),
        (f"<tool_call>sure {CALL} done</tool_call>", [("call_0", "f", '{"a":1}', "recovered")]),
        ('<tool_call>{"name": "f"}</tool_call>', [("call_0", "f", "{}", "parsed")]),
        ('<tool_call>{"name": "f", "arguments": "{\\"a\\": 1}"}</tool_call>', [("call_0", "f", '{"a": 1}', "parsed")]),
        ('<tool_call>{"name": "f", "arguments": {"ö": "ü"}}</tool_call>', [("call_0", "f", '{"ö":"ü"}', "parsed")]),
        ('<tool_call>{"arguments": {}}</tool_call>', []),
        ('<tool_call>so {"arguments": {}}</tool_call>', [("call_0", "", "{}", "recovered")]),
        ("<tool_call>{'name': 'f'}</tool_call>", []),
        ("<tool_call>[1, 2]</tool_call>", []),
        ("<tool_call>7</tool_call>", []),
        ('<tool_call>"name"</tool_call>', []),
        ("<tool_call>null</tool_call>", []),
        ("<tool_call>}{</tool_call>", []),
        (f"<tool_call>{CALL}", []),
        ("nothing", []),
        (None, []),
    ],
)
def test_extraction(calls, content, expected):
    assert calls(content) == expected


def test_a_broken_call_leaves_a_gap_in_the_ids(calls):
    content = f'<tool_call>{{"name": </tool_call> then <tool_call>{CALL}</tool_call>'
    assert [call[0] for call in calls(content)] == ["call_1"]
    assert [call[3] for call in calls(content, keep_dropped=True)] == ["dropped", "parsed"]


def test_structured_calls_win(spark, rows):
    schema = f"conv_id long, turn long, content string, tool_calls ARRAY<{schemas.TOOL_CALL}>"
    native = [{"id": "n1", "type": "function", "function": {"name": "g", "arguments": "{}"}}]
    text = f"<tool_call>{CALL}</tool_call>"
    df = spark.createDataFrame([(1, 1, text, native), (1, 2, text, []), (1, 3, text, None)], schema)
    got = rows(tc.extract_tool_calls(df), "turn", "name", "outcome")
    assert got == [(1, "g", "structured"), (2, "f", "parsed"), (3, "f", "parsed")]


def test_incomplete(spark):
    df = spark.createDataFrame([("<tool_call>x",), ("<tool_call>x</tool_call>",), ("x",)], "c string")
    assert [r[0] for r in df.select(tc.is_incomplete_call(F.col("c"))).collect()] == [True, False, False]


@pytest.fixture(scope="module")
def tools(spark):
    parameters = {
        "properties": {"a": {"type": "integer", "description": "First"}, "b": {"type": "string"}},
        "required": ["a"],
    }
    return tc.tool_row(spark, "f", "Does f", parameters).unionByName(tc.tool_row(spark, "g", "Does g", {}))


CALLS = "conv_id long, turn long, ordinal int, id string, name string, arguments string"


def test_validation(spark, tools, rows):
    df = spark.createDataFrame(
        [
            (1, 1, 0, "c", "f", '{"a": 1, "z": 2}'),
            (1, 2, 0, "c", "f", '{"b": "x"}'),
            (1, 3, 0, "c", "f", '{"a": {"deep": 1}}'),
            (1, 4, 0, "c", "g", "{}"),
            (1, 5, 0, "c", "h", "{}"),
        ],
        CALLS,
    )
    got = rows(tc.validate_calls(df, tools), "turn", "verdict", "invalid", "missing")
    assert got == [
        (1, "invalid", ["z"], []),
        (2, "missing", [], ["a"]),
        (3, "ok", [], []),
        (4, "ok", [], []),
        (5, "unknown", None, None),
    ]
    lost = tc.unknown_tools(df, tools).collect()
    assert [row.error for row in lost] == ["Error: Unknown tool 'h'"]


def test_execution_turns_failures_into_text(spark, tools):
    def f(a, b="-"):
        if a == 1:
            raise ValueError("Invalid params: z")
        if a == 2:
            raise ValueError("a is required")
        if a == 3:
            raise ValueError("boom")
        return f"{a}{b}"

    registry = tc.register({}, "f", f)
    arguments = ['{"a": 1, "z": 2}', '{"a": 2}', '{"a": 3}', '{"a": 4, "b": "x"}', "not json", '{"b": "x"}', None]
    df = spark.createDataFrame(
        [(1, turn, 0, f"call_{turn}", "f", given) for turn, given in enumerate(arguments)] + [(1, 9, 0, "call_9", "q", "{}")],
        CALLS,
    )
    # A wrong keyword fails before the body runs, so the first call gets the generic line.
    got = {r.turn: r.content for r in tc.execute_calls(df, registry, tools).collect()}
    assert got[0] == "Error executing f: " + got[0].split(": ", 1)[1] and "unexpected keyword" in got[0]
    assert got[1] == (
        "Tool call failed: f\n\nError: a is required\n\nRequired parameters:\n  • a: First\n\n"
        "Optional parameters:\n  • b: No description\n\nPlease call the tool again with all required parameters."
    )
    assert got[2] == "Error executing f: boom"
    assert got[3] == "4x"
    assert got[4].startswith("Error executing f: ")
    assert got[5].startswith("Tool call failed: f\n\nError: ") and "Missing required parameter(s): a" in got[5]
    assert got[9] == "Error: Unknown tool 'q'"


def test_invalid_parameter_report(spark, tools):
    df = spark.createDataFrame([(1, 1, 0, "c", "f", '{"a": 1, "z": 2}')], CALLS)
    report = tc.validate_calls(df, tools).first().report
    assert report == (
        "Tool call failed: f\n\nError: invalid params\n\nInvalid parameter(s): z\n\nValid parameters for this tool:\n"
        "  • a (required): First\n  • b (optional): No description\n\n"
        "Please call the tool again with only the valid parameters listed above."
    )


def test_error_classes(spark):
    rows = [
        (1, 30000, "x llama_decode returned -1", "context"),
        (2, 100, "llama_decode", "completed"),
        (1, 100, "llama_decode", "decode"),
        (1, 100, "Context window SIZE exceeded", "context"),
        (1, 100, "other", "generic"),
    ]
    df = spark.createDataFrame([(i, t, 32768, e, k) for i, t, e, k in rows], "iteration int, approx_tokens long, n_ctx long, error string, want string")
    assert all(r.kind == r.want for r in tc.classify_errors(df).collect())


def test_lone_surrogates_and_deep_payloads_do_not_end_a_job(spark):
    deep = "[" * 100_000
    contents = [
        '<tool_call>{"name": "f\\ud800", "arguments": {"x": "\\udfff"}}</tool_call>',
        f'<tool_call>{{"name": "f", "arguments": {deep}}}</tool_call>',
    ]
    df = spark.createDataFrame([(1, n, "assistant", text) for n, text in enumerate(contents)], "conv_id long, turn long, role string, content string")
    found = tc.extract_tool_calls(df).collect()
    assert [(r.turn, r.name, r.arguments) for r in found] == [(0, "f\\ud800", '{"x":"\\udfff"}')]


def test_undecodable_arguments_have_a_verdict_of_their_own(spark):
    catalog = tc.tool_row(spark, "f", "F", {"properties": {"x": {"type": "string"}}, "required": ["x"]})
    given = [('{"x": 1}', "ok"), ('{"x": ', "undecodable"), (None, "missing"), ("{}", "missing"), ('{"y": 1}', "invalid")]
    calls = spark.createDataFrame([("f", arguments, want) for arguments, want in given], "name string, arguments string, want string")
    for row in tc.validate_calls(calls, catalog).collect():
        assert row.verdict == row.want
        assert (row.missing is None) == (row.want == "undecodable") and (row.report is None) == (row.want == "ok")
