"""Batch inference with models given as Python callables.

Spark's part is batching, isolation of failures, parsing and retry. A text model is
``fn(prompts: list[str]) -> list[str]``; an embedding model is ``fn(texts: list[str])`` returning one
vector per text. A call that fails is repeated text by text, so that one bad text cannot fail its
batch. Without a model, summaries are the text's own first statements and vectors are hashed
bags of words; both then run without a Python model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lorekeep import schemas
from lorekeep.functions import prompts, text as tx, vectors as vx
from lorekeep.operators.arrow import arrow_step
from lorekeep.operators.chunking import with_sub_chunks

TextModel = Callable[[list[str]], Sequence[str]]
EmbeddingModel = Callable[[list[str]], Sequence[Sequence[float]]]

# Texts per model call.
CALL_SIZE = 256

_ANSWER = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])
_ANSWER_ARROW = pa.struct([("text", pa.string()), ("error", pa.string())])
_VECTOR = T.ArrayType(T.FloatType())


def _answers(fn: Callable, inputs: list) -> list[tuple[object, str | None]]:
    """(answer, error) per input; null inputs are not sent to the model."""
    out: list[tuple[object, str | None]] = [(None, None)] * len(inputs)
    asked = [place for place, value in enumerate(inputs) if value is not None]
    for first in range(0, len(asked), CALL_SIZE):
        places = asked[first : first + CALL_SIZE]
        try:
            found = list(fn([inputs[place] for place in places]))
            if len(found) != len(places):
                raise ValueError("the model returned a different number of answers")
            results = [(answer, None) for answer in found]
        except Exception:
            results = []
            for place in places:
                try:
                    results.append((list(fn([inputs[place]]))[0], None))
                except Exception as failure:
                    results.append((None, str(failure)))
        for place, result in zip(places, results):
            out[place] = result
    return out


def _answer_rows(fn: TextModel, inputs: list) -> list[dict]:
    return [
        {"text": None if answer is None else str(answer), "error": error}
        for answer, error in _answers(fn, inputs)
    ]


def _lists(flat: pa.Array, like: pa.Array) -> pa.Array:
    """``flat`` in lists as long as those of ``like``."""
    sizes = like.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def _one(name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind)])


def with_answer(df: DataFrame, prompt: Column, fn: TextModel, out: str) -> DataFrame:
    """Add STRUCT<text, error>, the model's answer to each prompt; null prompts are not sent."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(_answer_rows(fn, texts.to_pylist()), _ANSWER_ARROW)]

    return arrow_step(df, {"prompt": prompt}, _one(out, _ANSWER), compute)


def _with_answers(df: DataFrame, prompt_list: Column, fn: TextModel, out: str) -> DataFrame:
    """``with_answer`` for each element of an array column."""

    def compute(lists: pa.Array) -> list[pa.Array]:
        return [_lists(pa.array(_answer_rows(fn, lists.flatten().to_pylist()), _ANSWER_ARROW), lists)]

    return arrow_step(df, {"prompts": prompt_list}, _one(out, T.ArrayType(_ANSWER)), compute)


def _vectors(fn: EmbeddingModel | None, dim: int, inputs: list) -> pa.Array:
    """A vector per input; null where the model failed."""
    if fn is None:
        return vx.vector_lists(vx.hash_vectors(inputs, dim))
    rows = [
        None if vector is None else np.asarray(vector, dtype=np.float32)
        for vector, _ in _answers(fn, inputs)
    ]
    return pa.array(rows, pa.list_(pa.float32()))


def embed(
    df: DataFrame,
    text_col: str = "text",
    fn: EmbeddingModel | None = None,
    out: str = "embedding",
    dim: int = schemas.EMBEDDING_DIM,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add the vector of a text column, null where the model failed.

    ``keep`` names the columns wanted besides the vector; leaving the text out saves moving it
    back from Python.
    """

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [_vectors(fn, dim, texts.to_pylist())]

    return arrow_step(df, {"text": F.col(text_col)}, _one(out, _VECTOR), compute, keep)


def _collect_statements(
    df: DataFrame, texts: Column, prompt_of: Callable[[Column, Column], Column], fn: TextModel | None,
    n: int, attempts: int,
) -> DataFrame:
    """Add ``_parts``: per text of the array its statements and the last error.

    Each further attempt asks only for what is still missing; what was found before is kept.
    """
    if fn is None:
        parts = F.transform(
            texts,
            lambda text: F.struct(
                tx.parse_statements(text, n).alias("got"), F.lit(None).cast("string").alias("error")
            ),
        )
        return df.withColumn("_parts", parts)
    nothing = F.array().cast("array<string>")
    df = df.withColumn("_texts", texts).withColumn(
        "_parts",
        F.transform(
            "_texts",
            lambda text: F.struct(nothing.alias("got"), F.lit(None).cast("string").alias("error")),
        ),
    )
    for _ in range(attempts):
        asked = F.zip_with(
            "_texts",
            "_parts",
            lambda text, part: F.when(
                F.size(part["got"]) < n, prompt_of(text, F.lit(n) - F.size(part["got"]))
            ),
        )
        df = _with_answers(df, asked, fn, "_answers")
        merged = F.zip_with(
            "_parts",
            "_answers",
            lambda part, reply: F.struct(
                F.concat(
                    part["got"],
                    F.coalesce(
                        tx.parse_statements(reply["text"], F.lit(n) - F.size(part["got"])), nothing
                    ),
                ).alias("got"),
                F.coalesce(reply["error"], part["error"]).alias("error"),
            ),
        )
        df = df.withColumn("_parts", merged).drop("_answers")
    return df.drop("_texts")


def _joined_statements(parts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Per row: the statements of all its parts in order, and the reason when there are none."""
    flat = parts.flatten()
    found, errors = pc.struct_field(flat, "got"), pc.struct_field(flat, "error").to_pylist()
    ends = np.r_[0, np.cumsum(parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    places = np.r_[0, np.cumsum(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    statements = pa.ListArray.from_arrays(pa.array(places[ends].astype(np.int32)), found.flatten())
    reasons: list[str | None] = [None] * len(parts)
    for row in np.flatnonzero(places[ends[1:]] == places[ends[:-1]]):
        told = [error for error in errors[ends[row] : ends[row + 1]] if error is not None]
        reasons[row] = told[-1] if told else "Failed to generate any summaries"
    return statements, pa.array(reasons, pa.string())


def _finished(df: DataFrame, out: str, embed_with: tuple[EmbeddingModel | None, int] | None = None) -> DataFrame:
    """Replace ``_parts`` by the statements, the error and, on request, their vectors."""
    added = [T.StructField(out, T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]
    if embed_with is not None:
        added.append(T.StructField("embeddings", T.ArrayType(_VECTOR)))

    def compute(parts: pa.Array) -> list[pa.Array]:
        statements, errors = _joined_statements(parts)
        if embed_with is None:
            return [statements, errors]
        vectors = _vectors(*embed_with, statements.flatten().to_pylist())
        return [statements, errors, _lists(vectors, statements)]

    keep = [name for name in df.columns if name != "_parts"]
    return arrow_step(df, {"parts": F.col("_parts")}, T.StructType(added), compute, keep)


def summarize(
    df: DataFrame, text_col: str = "text", fn: TextModel | None = None, n: int = 3, attempts: int = 2
) -> DataFrame:
    """Replace the text by ``summaries``, up to ``n`` statements, and ``error`` when there is none."""
    parts = _collect_statements(df, F.array(F.col(text_col)), prompts.summary_prompt, fn, n, attempts)
    return _finished(parts.drop(text_col), "summaries")


def _chunk_statements(
    chunks: DataFrame, fn: TextModel | None, n: int, attempts: int, size: int, overlap: int
) -> DataFrame:
    pieces = with_sub_chunks(chunks, "_pieces", size=size, overlap=overlap)
    parts = _collect_statements(pieces, F.col("_pieces"), prompts.summary_prompt, fn, n, attempts)
    return parts.drop("_pieces")


def summarize_chunks(
    chunks: DataFrame,
    fn: TextModel | None = None,
    n: int = schemas.SUMMARIES_PER_CHUNK,
    attempts: int = 2,
    size: int = schemas.SUB_CHUNK_SIZE,
    overlap: int = schemas.SUB_CHUNK_OVERLAP,
) -> DataFrame:
    """Replace the text by ``questions``: ``n`` statements per embedding-sized piece, in order.

    Pieces that give nothing are skipped; ``error`` is set only when all of them fail. Everything
    happens inside the row, so there is no shuffle.
    """
    return _finished(_chunk_statements(chunks, fn, n, attempts, size, overlap), "questions")


def index_chunks(
    chunks: DataFrame,
    summarize_fn: TextModel | None = None,
    embed_fn: EmbeddingModel | None = None,
    n: int = schemas.SUMMARIES_PER_CHUNK,
    attempts: int = 2,
    dim: int = schemas.EMBEDDING_DIM,
) -> DataFrame:
    """One indexing attempt per chunk: ``questions``, ``embeddings``, ``status`` and ``error``.

    A chunk is ``complete`` when it has statements and each of them has a vector.
    """
    parts = _chunk_statements(
        chunks, summarize_fn, n, attempts, schemas.SUB_CHUNK_SIZE, schemas.SUB_CHUNK_OVERLAP
    )
    done = _finished(parts, "questions", (embed_fn, dim))
    no_vector = F.exists("embeddings", lambda vector: vector.isNull())
    error = F.coalesce("error", F.when(no_vector, "Failed to embed a summary"))
    return done.withColumn("error", error).withColumn(
        "status", F.when(F.col("error").isNull(), "complete").otherwise("failed")
    )


def explode_questions(indexed: DataFrame) -> DataFrame:
    """One row per statement and vector of the complete chunks, with its id."""
    rows = (
        indexed.filter(F.col("status") == "complete")
        .select("chunk_id", F.posexplode(F.arrays_zip("questions", "embeddings")).alias("ordinal", "_pair"))
    )
    return rows.select(
        tx.question_id(F.col("chunk_id"), F.col("ordinal")).alias("question_id"),
        "chunk_id",
        "ordinal",
        F.col("_pair.questions").alias("question"),
        F.col("_pair.embeddings").alias("embedding"),
    )


def expand_queries(
    queries: DataFrame,
    fn: TextModel | None = None,
    expansions: DataFrame | None = None,
    max_words: int = schemas.EXPAND_MAX_WORDS,
) -> DataFrame:
    """Add ``search_text``: a longer form of each short query, or the query itself.

    The longer form comes from a model or from a table ``query_id, expansion``. Queries above
    ``max_words`` words are left alone, and a form that is not longer is not taken.
    """
    short = tx.word_count(F.col("text")) <= max_words
    if expansions is not None:
        found = queries.join(expansions.select("query_id", "expansion"), "query_id", "left")
    elif fn is not None:
        asked = F.when(short, prompts.expand_prompt(F.col("text")))
        found = with_answer(queries, asked, fn, "_answer").withColumn(
            "expansion", tx.strip(F.col("_answer.text"))
        )
    else:
        return queries.withColumn("search_text", F.col("text"))
    longer = F.char_length("expansion") > F.char_length("text")
    taken = F.when(short & longer, F.col("expansion")).otherwise(F.col("text"))
    return found.withColumn("search_text", taken).drop("expansion", "_answer")


def refine_answers(
    df: DataFrame,
    fn: TextModel,
    question_col: str = "question",
    answer_col: str = "answer",
    max_chars: int = schemas.REFINE_MAX_CHARS,
) -> DataFrame:
    """Add ``refined``: the model's version of each answer, or the answer when the model failed."""
    draft = tx.truncated(F.col(answer_col), max_chars, prompts.TRUNCATION_MARKER)
    asked = F.when(F.col(answer_col) != "", prompts.refine_prompt(F.col(question_col), draft))
    return (
        with_answer(df, asked, fn, "_answer")
        .withColumn("refined", F.coalesce(tx.strip(F.col("_answer.text")), F.col(answer_col)))
        .drop("_answer")
    )
