"""Tool calls in messages: extraction, validation, execution, error classes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lorekeep import schemas
from lorekeep.operators.arrow import arrow_rows, arrow_step

# The tags around a call.
OPEN_TAG = "<tool_call>"
CLOSE_TAG = "</tool_call>"
_CALL = re.compile(r"<tool_call>+\s*(.*?)\s*</tool_call>", re.DOTALL)
_TAG = re.compile(r"</?tool_call>")

_CALL_ROW = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("arguments", T.StringType()),
        T.StructField("outcome", T.StringType()),
    ]
)


def _storable(text: str) -> str:
    """The text with lone surrogates, which no file can hold, as the escapes that JSON has for them."""
    return text.encode("utf-8", "backslashreplace").decode("utf-8")


def _as_text(value: object) -> str | None:
    if value is None:
        return None
    return _storable(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def _read_payload(payload: str) -> tuple[dict | None, str]:
    """The call object in a payload, and how it was read: parsed, recovered or dropped."""
    try:
        found = json.loads(_TAG.sub("", payload).strip())
        named = isinstance(found, dict) and "name" in found
        return (found, "parsed") if named else (None, "dropped")
    except (ValueError, RecursionError):
        pass
    braces = payload[payload.find("{") : payload.rfind("}") + 1] if "{" in payload else ""
    try:
        return json.loads(braces), "recovered"
    except (ValueError, RecursionError):
        return None, "dropped"


def _calls_in(content: str) -> Iterator[tuple]:
    """(ordinal, id, name, arguments, outcome) of every tagged payload."""
    for ordinal, payload in enumerate(_CALL.findall(content)):
        found, outcome = _read_payload(payload)
        name = arguments = None
        if found is not None:
            name, arguments = _as_text(found.get("name", "")), _as_text(found.get("arguments", "{}"))
        yield ordinal, f"call_{ordinal}", name, arguments, outcome


def _readable_calls_in(content: str) -> Iterator[tuple]:
    return (call for call in _calls_in(content) if call[-1] != "dropped")


def is_incomplete_call(content: Column) -> Column:
    """An opening tag without any closing tag."""
    return content.contains(OPEN_TAG) & ~content.contains(CLOSE_TAG)


def _has_calls(messages: DataFrame) -> Column:
    if "tool_calls" not in messages.columns:
        return F.lit(False)
    return F.coalesce(F.size("tool_calls") > 0, F.lit(False))


def extract_tool_calls(messages: DataFrame, keep_dropped: bool = False) -> DataFrame:
    """One row per tool call: ``conv_id, turn, ordinal, id, name, arguments, outcome``.

    Structured calls win over calls written in the text. The ordinal counts every tagged payload,
    so a payload that cannot be read leaves a gap; ``keep_dropped`` shows those rows too. Only
    messages that hold a tag reach Python.
    """
    native = _has_calls(messages)
    written = F.col("content").contains(OPEN_TAG) & F.col("content").contains(CLOSE_TAG)
    keys = ["conv_id", "turn"]
    read = _calls_in if keep_dropped else _readable_calls_in
    found = arrow_rows(messages.filter(written & ~native), F.col("content"), _CALL_ROW, read, keys)
    if "tool_calls" not in messages.columns:
        return found
    listed = messages.filter(native).select(
        *keys, F.posexplode("tool_calls").alias("ordinal", "_call")
    )
    structured = listed.select(
        *keys,
        "ordinal",
        F.col("_call.id").alias("id"),
        F.col("_call.function.name").alias("name"),
        F.col("_call.function.arguments").alias("arguments"),
        F.lit("structured").alias("outcome"),
    )
    return structured.unionByName(found)


def _decoded(arguments: Column) -> Column:
    """Arguments as a map from parameter to JSON or plain text."""
    return F.from_json(arguments, "map<string,string>")


# The texts given back to a caller whose call failed.
FAILED = "Tool call failed: %s\n\nError: %s\n\n"
INVALID = "Invalid parameter(s): %s\n\n"
MISSING = "Missing required parameter(s): %s\n\n"
VALID_HEAD = "Valid parameters for this tool:\n"
REQUIRED_HEAD = "Required parameters:\n"
OPTIONAL_HEAD = "\nOptional parameters:\n"
INVALID_TAIL = "\nPlease call the tool again with only the valid parameters listed above."
MISSING_TAIL = "\nPlease call the tool again with all required parameters."
UNKNOWN = "Error: Unknown tool '%s'"
GENERIC = "Error executing %s: %s"
# What a call gets whose arguments are no JSON object.
UNDECODABLE = "arguments are not a JSON object"
NO_DESCRIPTION = "No description"


def _listed(names: Column, label: Callable[[Column], Column]) -> Column:
    """One bullet per parameter in ``names``, with its description."""

    def bullet(name: Column) -> Column:
        about = F.coalesce(F.try_element_at("_params", name)["description"], F.lit(NO_DESCRIPTION))
        return F.concat(F.lit("  • "), name, label(name), F.lit(": "), about, F.lit("\n"))

    return F.array_join(F.transform(names, bullet), "")


def _named(template: str, names: str) -> Column:
    """The names in the template, or nothing when there are none."""
    text = F.format_string(template, F.array_join(names, ", "))
    return F.when(F.size(names) > 0, text).otherwise("")


def _invalid_report(error: Column) -> Column:
    """Report on a call with parameters the tool does not have."""

    def flag(name: Column) -> Column:
        return F.when(F.array_contains("_required", name), " (required)").otherwise(" (optional)")

    return F.concat(
        F.format_string(FAILED, F.col("name"), error),
        _named(INVALID, "invalid"),
        F.lit(VALID_HEAD),
        _listed(F.map_keys("_params"), flag),
        F.lit(INVALID_TAIL),
    )


def _missing_report(error: Column) -> Column:
    """Report on a call that lacks required parameters."""

    def plain(name: Column) -> Column:
        return F.lit("")

    optional = F.concat(
        F.lit(OPTIONAL_HEAD), _listed(F.array_except(F.map_keys("_params"), "_required"), plain)
    )
    return F.concat(
        F.format_string(FAILED, F.col("name"), error),
        _named(MISSING, "missing"),
        F.lit(REQUIRED_HEAD),
        _listed(F.col("_required"), plain),
        F.when(F.size("_params") > F.size("_required"), optional).otherwise(""),
        F.lit(MISSING_TAIL),
    )


def _with_catalog(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls with their tool's parameters; ``known`` tells whether the tool is registered.

    A tool that a third of all calls name is one row on the right side: the join is a broadcast
    for a small catalog, and for a large one the skewed partition is split at run time.
    """
    nothing = F.array().cast("array<string>")
    catalog = tools.select(
        "name",
        F.coalesce("params", F.create_map().cast(schemas.PARAMS)).alias("_params"),
        F.coalesce("required", nothing).alias("_required"),
        F.lit(True).alias("known"),
    )
    joined = calls.join(catalog, "name", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    decoded = _decoded(F.col("arguments"))
    joined = joined.withColumn("_readable", F.col("arguments").isNull() | decoded.isNotNull())
    given, checked = F.coalesce(F.map_keys(decoded), nothing), F.col("known") & F.col("_readable")
    return joined.withColumns(
        {
            "invalid": F.when(checked, F.array_except(given, F.map_keys("_params"))),
            "missing": F.when(checked, F.array_except("_required", given)),
        }
    )


def unknown_tool_text(name: Column) -> Column:
    return F.format_string(UNKNOWN, name)


def unknown_tools(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls naming a tool that is not registered, with the error text they get."""
    lost = calls.join(tools.select("name"), "name", "left_anti")
    return lost.withColumn("error", unknown_tool_text(F.col("name")))


def validate_calls(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Each call with its invalid and missing parameters, a verdict and the report text.

    Arguments that are no JSON object cannot be checked: verdict ``undecodable``, both lists null.
    """
    checked = _with_catalog(calls, tools)
    verdict = (
        F.when(~F.col("known"), "unknown")
        .when(~F.col("_readable"), "undecodable")
        .when(F.size("invalid") > 0, "invalid")
        .when(F.size("missing") > 0, "missing")
        .otherwise("ok")
    )
    report = (
        F.when(F.col("verdict") == "unknown", unknown_tool_text(F.col("name")))
        .when(F.col("verdict") == "undecodable", F.format_string(GENERIC, F.col("name"), F.lit(UNDECODABLE)))
        .when(F.col("verdict") == "invalid", _invalid_report(F.lit("invalid params")))
        .when(F.col("verdict") == "missing", _missing_report(F.lit("missing required params")))
    )
    return checked.withColumn("verdict", verdict).withColumn("report", report).drop(
        "_params", "_required", "_readable", "known"
    )


def register(registry: Mapping[str, Callable], name: str, fn: Callable) -> dict[str, Callable]:
    """A registry with ``fn`` under ``name``; registering a name again replaces it."""
    return {**registry, name: fn}


def tool_row(spark, name: str, description: str, parameters: dict) -> DataFrame:
    """The catalog row of a registered function."""
    params = {
        key: (about.get("type"), about.get("description"))
        for key, about in parameters.get("properties", {}).items()
    }
    row = (name, description, None, params, parameters.get("required", []), json.dumps(parameters))
    return spark.createDataFrame([row], schemas.TOOLS)


_RESULT = T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])
_RESULT_ARROW = pa.struct([("value", pa.string()), ("error", pa.string())])


def _run_call(registry: Mapping[str, Callable], name: str | None, arguments: str | None) -> dict:
    if name not in registry:
        return {"value": UNKNOWN % name}
    try:
        given = json.loads(arguments if arguments is not None else "{}")
        return {"value": _storable(str(registry[name](**given)))}
    except Exception as failure:
        return {"error": _storable(str(failure))}


def execute_calls(calls: DataFrame, registry: Mapping[str, Callable], tools: DataFrame) -> DataFrame:
    """Run each call by name; the result is a tool message carrying the call's id.

    Failures become text: the parameter reports for invalid or missing parameters, else a generic
    line.
    """
    functions = dict(registry)

    def run(names: pa.Array, arguments: pa.Array) -> list[pa.Array]:
        pairs = zip(names.to_pylist(), arguments.to_pylist())
        return [pa.array([_run_call(functions, name, given) for name, given in pairs], _RESULT_ARROW)]

    inputs = {"name": F.col("name"), "arguments": F.col("arguments")}
    ran = arrow_step(calls, inputs, T.StructType([T.StructField("_result", _RESULT)]), run)
    told = _with_catalog(ran, tools)
    error = F.col("_result.error")
    kind = classify_tool_errors(error)
    content = (
        F.when(error.isNull(), F.col("_result.value"))
        .when(kind == "invalid_params", _invalid_report(error))
        .when(kind == "missing_params", _missing_report(error))
        .otherwise(F.format_string(GENERIC, F.col("name"), error))
    )
    return told.select(
        "conv_id", "turn", "ordinal", F.col("id").alias("tool_call_id"), "name",
        F.lit("tool").alias("role"), content.alias("content"),
    )


def classify_tool_errors(error: Column) -> Column:
    """Kind of a tool's error text."""
    lowered = F.lower(error)
    return (
        F.when(
            lowered.contains("invalid params") | lowered.contains("unexpected additional properties"),
            "invalid_params",
        )
        .when(lowered.contains("required") | lowered.contains("missing"), "missing_params")
        .otherwise("generic")
    )


def classify_errors(errors: DataFrame, pressure: float = schemas.CONTEXT_PRESSURE) -> DataFrame:
    """Kind of each engine error: ``iteration, approx_tokens, n_ctx, error`` in, ``kind`` added.

    A decode error is a context problem only near the limit; after the first step it counts as
    done, on the first step as a model problem.
    """
    decode = F.col("error").contains("llama_decode")
    lowered = F.lower("error")
    kind = (
        F.when(decode & (F.col("approx_tokens") > F.col("n_ctx") * pressure), "context")
        .when(decode & (F.col("iteration") > 1), "completed")
        .when(decode, "decode")
        .when(lowered.contains("context") & lowered.contains("size"), "context")
        .otherwise("generic")
    )
    return errors.withColumn("kind", kind)
