"""What several operators of the pipeline share: words, Arrow steps, row keys, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Words in the sense of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Words of letters and digits, for texts whose A-Z are in lower case.
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A side of a join is broadcast up to so many rows, counted before.
BROADCAST_ROWS = 100_000
# Rows to an Arrow batch of texts; long texts make large batches, so few rows are taken at a time.
_ROWS = 256


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def row_key(id_column: str, text_column: str) -> Column:
    """Names a row by id and text: rows that repeat share it, others with the same id do not."""
    return F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text"))


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of neutral names, which clash with none, and these names by the given ones."""
    names = {name: f"_c{at}" for at, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def shown(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``hidden`` under their own names; nothing else."""
    return docs.select(*[F.col(neutral).alias(name) for name, neutral in names.items()])


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if small(df, limit) else df


def map_rows(
    df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], Iterator[dict[str, list] | pa.RecordBatch]]
) -> DataFrame:
    """Arrow step over slices of at most ``_ROWS`` rows; ``step`` yields columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                for out in step(batch.slice(start, _ROWS)):
                    if isinstance(out, dict):
                        arrays = [
                            value.cast(field.type)
                            if isinstance(value, pa.Array)
                            else pa.array(value, type=field.type)
                            for field, value in ((field, out[field.name]) for field in arrow)
                        ]
                        out = pa.RecordBatch.from_arrays(arrays, schema=arrow)
                    yield out

    return df.mapInArrow(run, schema)
