"""Prompt columns for the models a user plugs in. The wording is ours and held as data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SUMMARY_PROMPT = (
    "Write %d factual statements about the passage below. Put each on its own line, use 15 to 30 "
    "words, cover different points and add no numbering.\n\nPassage:\n%s\n\nStatements:"
)
TOOL_SUMMARY_PROMPT = (
    "Write %d statements about what the tool below does and when it helps, one per line, 15 to 30 "
    "words each, without numbering.\n\nName: %s\nAbout: %s\n\nStatements:"
)
EXPAND_PROMPT = (
    "Rewrite the search request as one line of 15 to 25 words for searching documentation. Keep to "
    "what the request names.\n\nRequest: %s\n\nRewritten:"
)
REFINE_PROMPT = (
    "Improve the draft so that it answers the question directly, stays brief and keeps every "
    "example and technical detail. Return the answer only.\n\nQuestion:\n%s\n\nDraft:\n%s\n\nAnswer:"
)
PLAN_PROMPT = (
    "Question: %s\n\nList the numbered steps needed to answer it, with the facts and tools each "
    "step needs, and then carry them out in order."
)
TOOL_PROMPT_CLOSING = (
    "How to answer:\n"
    "- To use a tool, output one <tool_call> block with valid JSON and nothing else.\n"
    "- Answer the question that was asked, from tool results only, in at most 20 lines.\n"
    "- When the results do not hold the answer, say that you do not have it."
)
TRUNCATION_MARKER = "\n\n[Response truncated for refinement]"


def summary_prompt(text: Column, n: Column | int) -> Column:
    count = n if isinstance(n, Column) else F.lit(n)
    return F.format_string(SUMMARY_PROMPT, count, text)


def tool_summary_prompt(name: Column, description: Column, n: int) -> Column:
    return F.format_string(TOOL_SUMMARY_PROMPT, F.lit(n), name, description)


def expand_prompt(query: Column) -> Column:
    return F.format_string(EXPAND_PROMPT, query)


def refine_prompt(question: Column, draft: Column) -> Column:
    return F.format_string(REFINE_PROMPT, question, draft)


def plan_prompt(question: Column) -> Column:
    return F.format_string(PLAN_PROMPT, question)
