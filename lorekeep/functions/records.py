"""Messages and tools as JSON strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def message_json(messages: DataFrame) -> Column:
    """A message in wire form: empty fields are left out."""

    def text(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")).alias(name)

    fields = [F.col("role")]
    if "content" in messages.columns:
        fields.append(text("content"))
    if "tool_calls" in messages.columns:
        fields.append(F.when(F.size("tool_calls") > 0, F.col("tool_calls")).alias("tool_calls"))
    fields += [text(name) for name in ("tool_call_id", "name") if name in messages.columns]
    return F.to_json(F.struct(*fields))


def tool_json(name: Column, description: Column, parameters_json: Column) -> Column:
    """A tool in wire form; the parameter schema is kept as the JSON text it came as."""
    head = F.to_json(F.struct(name.alias("name"), description.alias("description")))
    return F.concat(
        F.lit('{"type":"function","function":'),
        F.substring(head, F.lit(1), F.char_length(head) - 1),
        F.lit(',"parameters":'),
        parameters_json,
        F.lit("}}"),
    )


def iso_timestamp(ts: Column) -> Column:
    """ISO form; the fraction has six digits and is left out when it is zero."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
