"""Explicit schemas of the stored and exchanged tables."""

from __future__ import annotations

DOCS = "doc_key STRING, source STRING, text STRING"

CHUNKS = "chunk_id LONG, hash STRING, source STRING, pos INT, length INT, text STRING"

CHUNK_STATUS = "chunk_id LONG, attempt INT, status STRING, error STRING, questions ARRAY<STRING>, next_try_at TIMESTAMP"

QUESTIONS = "question_id STRING, chunk_id LONG, ordinal INT, question STRING, embedding ARRAY<FLOAT>"

PARAMS = "MAP<STRING, STRUCT<type: STRING, description: STRING>>"

TOOLS = (
    "name STRING, description STRING, server STRING, "
    f"params {PARAMS}, required ARRAY<STRING>, parameters_json STRING"
)

TOOL_SUMMARIES = "tool STRING, ordinal INT, summary STRING, embedding ARRAY<FLOAT>"

TOOL_CALL = "STRUCT<id: STRING, type: STRING, function: STRUCT<name: STRING, arguments: STRING>>"

MESSAGES = (
    "conv_id LONG, turn LONG, role STRING, content STRING, ts TIMESTAMP, "
    f"tool_calls ARRAY<{TOOL_CALL}>, tool_call_id STRING, name STRING"
)

HITS = "query_id LONG, rank INT, chunk_id LONG, similarity DOUBLE, source STRING, text STRING"

TOOL_INDEX_FILE = (
    "metadata STRUCT<num_tools: INT, embedding_dim: INT, note: STRING>, "
    "tools MAP<STRING, STRUCT<description: STRING, example_queries: ARRAY<STRING>, "
    "query_stats: ARRAY<STRUCT<query: STRING, embedding_norm: DOUBLE>>>>"
)

# Defaults that results depend on; fixed values.
CHUNK_SIZE = 4000
CHUNK_OVERLAP = 400
SUB_CHUNK_SIZE = 1200
SUB_CHUNK_OVERLAP = 200
SUMMARIES_PER_CHUNK = 2
SUMMARIES_PER_TOOL = 5
TOP_CHUNKS = 3
HISTORY_MESSAGES = 20
PROMPT_MESSAGES = 10
DIGEST_MESSAGES = 5
DIGEST_WIDTH = 80
MAX_ITERATIONS = 5
CONTEXT_TOKENS = 32768
CHARS_PER_TOKEN = 4
CONTEXT_PRESSURE = 0.8
REFINE_MAX_CHARS = 8000
EXPAND_MAX_WORDS = 10
EMBEDDING_DIM = 256
