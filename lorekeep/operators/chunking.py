"""Structure-aware chunking.

A cut depends on where the previous one fell, so a text is walked from start to end inside one
Arrow task; texts are independent and Spark spreads them over the tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lorekeep import schemas
from lorekeep.functions import text as tx
from lorekeep.operators.arrow import SLICE_ROWS, arrow_step

# What marks a structure, and which separators are tried in which order.
FENCE = "```"
HEADING_MARKS = (("\n#", r"\n#{1,6}\s"), ("\n---", r"\n---+\n"), ("\n===", r"\n===+\n"))
BLANK_LINE = "\n\n"
SENTENCE_ENDS = (". \n", ".\n", ". ", "! ", "?\n")
SUB_SENTENCE_ENDS = (". ", ".\n", "! ", "?\n", "\n\n")
FENCE_SLACK = 1000
TABLE_REACH = 500
TABLE_PIPES = 2

# Output rows are handed over in batches of about this many characters.
_FLUSH_CHARS = 1_000_000

Span = tuple[int, int]


class _Fences:
    """Fence marks of one text, found once."""

    def __init__(self, text: str):
        self.text = text
        self.marks = [hit.start() for hit in re.finditer(FENCE, text)]
        self.last = text.rfind(FENCE)

    def covers(self, at: int) -> bool:
        """Whether an odd number of whole marks lies before ``at``."""
        return bisect_right(self.marks, at - len(FENCE)) % 2 == 1

    def exit_from(self, at: int) -> int:
        """First offset behind the next mark and its newline; ``at`` when no mark follows."""
        if at > self.last:
            return at
        behind = self.text.index(FENCE, at) + len(FENCE)
        return behind + 1 if self.text.startswith("\n", behind) else behind

    def last_mark_within(self, start: int, end: int) -> int | None:
        """Last of the non-overlapping marks counted from ``start``."""
        found = [hit.start() for hit in re.finditer(FENCE, self.text[start:end])]
        return start + found[-1] if found else None


def _between_pipes(text: str, at: int) -> bool:
    before = text.count("|", max(0, at - TABLE_REACH), at)
    return before >= TABLE_PIPES and text.count("|", at, at + TABLE_REACH) >= TABLE_PIPES


def _after_last(window: str, separators: Iterable[str], beyond: int) -> int | None:
    """Length of the window up to the first separator in the list whose last hit is far enough in."""
    for separator in separators:
        at = window.rfind(separator)
        if at > beyond:
            return at + len(separator)
    return None


def _section_length(window: str, size: int) -> int:
    """How much of the window to keep so that the cut falls between sections."""
    half = size // 2
    for hint, pattern in HEADING_MARKS:
        if hint in window:
            starts = [hit.start() for hit in re.finditer(pattern, window)]
            if starts and starts[-1] > half:
                return starts[-1]
    return (
        _after_last(window, (BLANK_LINE,), half)
        or _after_last(window, SENTENCE_ENDS, half)
        or _after_last(window, ("\n",), size // 3)
        or len(window)
    )


def _fence_cut(fences: _Fences, start: int, end: int, size: int) -> int:
    """Where to cut when ``end`` lies inside a fenced block."""
    closed = fences.exit_from(end)
    if end < closed < start + size + FENCE_SLACK:
        return closed
    opened = fences.last_mark_within(start, end)
    if opened is not None and opened - start > size // 2:
        return opened
    return max(end, closed)


def chunk_spans(text: str, size: int, overlap: int) -> Iterator[Span]:
    """Start and end of each window over ``text``, before stripping."""
    fences = _Fences(text)
    total = len(text)
    start = 0
    while start < total:
        if start and fences.covers(start):
            behind = fences.exit_from(start)
            if behind > start:
                start = behind
                while start < total and text[start] in " \t\n":
                    start += 1
                if start == total:
                    return
        end = start + size
        if end >= total:
            yield start, total
            return
        if fences.covers(end):
            end = _fence_cut(fences, start, end, size)
        else:
            gap = -1
            if _between_pipes(text, end):
                gap = text.find(BLANK_LINE, end, end + TABLE_REACH + len(BLANK_LINE) - 1) - end
            if gap > 0:
                end += gap + len(BLANK_LINE)
            else:
                end = start + _section_length(text[start:end], size)
        yield start, end
        if end >= total:
            return
        start = end - overlap


def sub_chunk_spans(text: str, size: int, overlap: int) -> Iterator[Span]:
    """Windows small enough for an embedding model."""
    total = len(text)
    start = 0
    while total - start > size:
        kept = _after_last(text[start : start + size], SUB_SENTENCE_ENDS, size // 2) or size
        yield start, start + kept
        start += kept - overlap
    if start < total:
        yield start, total


def sub_chunk_texts(text: str, size: int, overlap: int) -> list[str]:
    """Stripped windows of ``text``; a text that fits is kept as it is."""
    if len(text) <= size:
        return [text]
    pieces = (text[start:end].strip() for start, end in sub_chunk_spans(text, size, overlap))
    return [piece for piece in pieces if piece]


def _check_sizes(size: int, overlap: int) -> None:
    if not 0 <= overlap < size // 3:
        raise ValueError("overlap must be at least 0 and below a third of the size")


def _cut_rows(text_col: str, cut: Callable[[str], Iterator[Span]]):
    """A mapInArrow body: one row per non-empty window, other columns repeated."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            kept = batch.select([name for name in batch.schema.names if name != text_col])
            rows, spans, pieces, chars = [], [], [], 0

            def flush() -> pa.RecordBatch:
                carried = kept.take(pa.array(rows, pa.int64()))
                added = {
                    "pos": pa.array([pos for pos, _, _ in spans], pa.int32()),
                    "start": pa.array([start for _, start, _ in spans], pa.int32()),
                    "end": pa.array([end for _, _, end in spans], pa.int32()),
                    "text": pa.array(pieces, pa.string()),
                }
                return pa.RecordBatch.from_arrays(
                    carried.columns + list(added.values()), names=carried.schema.names + list(added)
                )

            for row, value in enumerate(texts):
                text = value.as_py()
                pos = 0
                for start, end in cut(text) if text else ():
                    piece = text[start:end].strip()
                    if not piece:
                        continue
                    rows.append(row)
                    spans.append((pos, start, end))
                    pieces.append(piece)
                    pos += 1
                    chars += len(piece)
                    if chars >= _FLUSH_CHARS:
                        yield flush()
                        rows, spans, pieces, chars = [], [], [], 0
            if rows:
                yield flush()
            # What the batch took goes back, so that a worker holds one batch and not the largest of each step.
            del texts, kept, rows, spans, pieces, batch
            pa.default_memory_pool().release_unused()

    return run


def _cut_frame(df: DataFrame, text_col: str, cut: Callable[[str], Iterator[Span]]) -> DataFrame:
    carried = [field for field in df.schema.fields if field.name != text_col]
    schema = T.StructType(
        carried
        + [
            T.StructField("pos", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("text", T.StringType()),
        ]
    )
    return df.mapInArrow(_cut_rows(text_col, cut), schema)


def chunk_documents(
    docs: DataFrame,
    size: int = schemas.CHUNK_SIZE,
    overlap: int = schemas.CHUNK_OVERLAP,
    text_col: str = "text",
) -> DataFrame:
    """Cut each text into overlapping chunks that respect fences, tables, headings and sentences.

    Adds ``pos``, ``start``, ``end``, ``length`` and ``hash``; ``text`` becomes the chunk's text.
    """
    _check_sizes(size, overlap)
    cut = _cut_frame(docs, text_col, lambda text: chunk_spans(text, size, overlap))
    return cut.withColumns(
        {"length": F.char_length("text"), "hash": tx.content_hash(F.col("text"))}
    )


def sub_chunks(
    df: DataFrame,
    text_col: str = "text",
    size: int = schemas.SUB_CHUNK_SIZE,
    overlap: int = schemas.SUB_CHUNK_OVERLAP,
) -> DataFrame:
    """One row per embedding-sized window of the texts above ``size`` characters."""
    _check_sizes(size, overlap)
    long_texts = df.filter(F.char_length(text_col) > size)
    return _cut_frame(long_texts, text_col, lambda text: sub_chunk_spans(text, size, overlap))


def with_sub_chunks(
    df: DataFrame,
    out: str,
    text_col: str = "text",
    size: int = schemas.SUB_CHUNK_SIZE,
    overlap: int = schemas.SUB_CHUNK_OVERLAP,
) -> DataFrame:
    """Replace the text by the array of its embedding-sized pieces, without a row per piece.

    Rows leave some hundred at a time: a function of columns would hold the pieces of a whole Arrow batch beside its texts.
    """
    _check_sizes(size, overlap)

    def compute(texts: pa.Array) -> list[pa.Array]:
        pieces = [[] if text is None else sub_chunk_texts(text, size, overlap) for text in texts.to_pylist()]
        return [pa.array(pieces, pa.list_(pa.string()))]

    added = T.StructType([T.StructField(out, T.ArrayType(T.StringType()))])
    return arrow_step(df, {"text": F.col(text_col)}, added, compute, [name for name in df.columns if name != text_col])


def sub_chunk_array(
    text: str = "text",
    size: int = schemas.SUB_CHUNK_SIZE,
    overlap: int = schemas.SUB_CHUNK_OVERLAP,
):
    """Column of the embedding-sized pieces of ``text``, without a row per piece."""
    _check_sizes(size, overlap)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def pieces(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        found = [pa.array([], kind)]
        for start in range(0, len(texts), SLICE_ROWS):
            values = texts.slice(start, SLICE_ROWS).to_pylist()
            found.append(pa.array([sub_chunk_texts(value, size, overlap) if value else [] for value in values], kind))
        return pa.concat_arrays(found)

    # A text that fits is not sent to Python.
    long_text = F.when(F.char_length(text) > size, F.col(text))
    return F.when(F.char_length(text) <= size, F.array(F.col(text))).otherwise(pieces(long_text))
