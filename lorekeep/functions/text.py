"""Text expressions: stripping, word counts, statements, previews, ids."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# White space, Unicode included, as a set of characters and as a pattern.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = r"[\s\x1c-\x1f]"
_INNER_SPACE = rf"(?U){_SPACE}+"
_NO_SPACE = r"(?U)[^\s\x1c-\x1f]"

# A line holding one of these is an instruction, not a statement.
INSTRUCTION_PHRASES = (
    "generate",
    "instructions:",
    "text:",
    "semantic summaries:",
    "tool:",
    "description:",
    "output only",
    "each statement",
    "do not number",
    "use present tense",
)
# Characters cut from the start of a line, then one "word." or "word)" label.
LEADING_MARKS = "0123456789.)-•*# "
LEADING_LABEL = rf"(?U)^[0-9a-zA-Z]+[.)]{_SPACE}+"
MIN_STATEMENT_WORDS = 10
SUMMARY_WORDS = (10, 40)
_LINES_AHEAD = 8


def strip(text: Column) -> Column:
    """Cut white space, Unicode included, from both ends."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """Whether there is nothing but white space; stops at the first other character."""
    return ~text.rlike(_NO_SPACE)


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    words = F.split(text, _INNER_SPACE)
    return F.size(F.filter(words, lambda word: word != ""))


def content_hash(text: Column) -> Column:
    """Identity of a chunk."""
    return F.md5(text)


def _is_instruction(line: Column) -> Column:
    """Phrases are looked for as they are, many times faster than by a pattern; the array binds the lower-cased line."""
    return F.exists(F.array(F.lower(line)), lambda low: reduce(or_, [low.contains(phrase) for phrase in INSTRUCTION_PHRASES]))


def _without_label(line: Column) -> Column:
    bare = strip(F.ltrim(line, F.lit(LEADING_MARKS)))
    return F.regexp_replace(bare, LEADING_LABEL, "")


def _statement(line: Column) -> Column:
    return strip(F.rtrim(strip(_without_label(line)), F.lit("?")))


def _is_long_enough(line: Column) -> Column:
    """At least ten words in a stripped line; splitting stops at the tenth."""
    return F.size(F.split(line, _INNER_SPACE, MIN_STATEMENT_WORDS)) >= MIN_STATEMENT_WORDS


def _statements(lines: Column) -> Column:
    """Those of the lines that read as statements, cleaned, in order."""
    stripped = F.transform(lines, strip)
    candidates = F.filter(stripped, lambda line: (line != "") & ~_is_instruction(line))
    return F.filter(F.transform(candidates, _statement), _is_long_enough)


def parse_statements(text: Column, n: int | Column = 3) -> Column:
    """The first ``n`` statements of ``text``; an empty array means that parsing failed.

    The first lines are tried on their own; only where they hold too few statements are all lines
    looked at.
    """
    wanted = n if isinstance(n, Column) else F.lit(n)

    def found_in(lines: Column) -> Column:
        def enough(found: Column) -> Column:
            done = (F.size(found) >= wanted) | (F.size(lines) <= _LINES_AHEAD)
            return F.when(done, found).otherwise(_statements(lines))

        return F.transform(F.array(_statements(F.slice(lines, 1, _LINES_AHEAD))), enough)[0]

    # One-element arrays bind the lines and the first result, so that each is computed once.
    return F.slice(F.transform(F.array(F.split(text, "\n")), found_in)[0], F.lit(1), wanted)


def summary_quality(summary: Column) -> Column:
    """``short`` below 10 words, ``long`` above 40, else ``ok``."""
    low, high = SUMMARY_WORDS
    words = word_count(summary)
    return F.when(words < low, "short").when(words > high, "long").otherwise("ok")


def preview(text: Column, width: int) -> Column:
    """The first ``width`` characters, with a note on how many more there are."""
    length = F.char_length(text)
    rest = F.format_string("... (%d more characters)", length - width)
    return F.when(length > width, F.concat(F.substring(text, 1, width), F.lit("\n"), rest)).otherwise(text)


def truncated(text: Column, width: int, marker: str) -> Column:
    """``text`` cut at ``width`` characters, with ``marker`` behind the cut."""
    cut = F.concat(F.substring(text, 1, width), F.lit(marker))
    return F.when(F.char_length(text) > width, cut).otherwise(text)


def question_id(chunk_id: Column, ordinal: Column) -> Column:
    return F.format_string("chunk_%d_q%d", chunk_id, ordinal)


def chunk_file_name(chunk_id: Column) -> Column:
    return F.format_string("chunk_%06d.txt", chunk_id)


def note_text(information: Column, context: Column) -> Column:
    """``context: information``, or the information alone when there is no context."""
    return F.when(context != "", F.concat(context, F.lit(": "), information)).otherwise(information)


def json_string(text: Column) -> Column:
    """``text`` as a quoted JSON string."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.char_length(wrapped) - 2)
