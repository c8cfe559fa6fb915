"""Arrow steps: the form in which operators call Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, types as T

# Rows of an Arrow batch that are worked on at a time, which bounds what a step holds besides its batch.
SLICE_ROWS = 512


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


def arrow_step(
    df: DataFrame,
    inputs: dict[str, Column],
    added: T.StructType,
    compute: Callable[..., list[pa.Array]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add the columns that ``compute`` makes of the input columns, batch by batch.

    A step of its own rather than a UDF: filters on its output cannot be pushed below it, where the
    model, or the parsing that leads to it, would run a second time.
    """
    kept = [name for name in (df.columns if keep is None else keep) if name not in added.fieldNames()]
    staged = df.select(*kept, *[column.alias(f"_in_{name}") for name, column in inputs.items()])
    taken, made = [f"_in_{name}" for name in inputs], added.fieldNames()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            new = compute(*[batch.column(name) for name in taken])
            old = [batch.column(name) for name in kept]
            yield pa.RecordBatch.from_arrays(old + new, names=kept + made)

    return staged.mapInArrow(run, T.StructType([df.schema[name] for name in kept] + added.fields))


def arrow_rows(
    df: DataFrame,
    value: Column,
    added: T.StructType,
    rows_of: Callable[[str], Iterable[tuple]],
    keep: Sequence[str],
) -> DataFrame:
    """Any number of rows per value, each with the kept columns of its source row.

    The rows come out one by one instead of as an array to explode, for which the planner would
    add a filter on its length and compute it twice.
    """
    kept = list(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        new = to_arrow_schema(added)
        for batch in _slices(batches):
            sources, found = [], []
            for source, text in enumerate(batch.column("_in").to_pylist()):
                for row in rows_of(text):
                    sources.append(source)
                    found.append(row)
            old = batch.select(kept).take(pa.array(sources, pa.int64()))
            columns = list(zip(*found)) or [()] * len(new)
            arrays = [pa.array(column, field.type) for column, field in zip(columns, new)]
            yield pa.RecordBatch.from_arrays(old.columns + arrays, names=kept + new.names)

    staged = df.select(*kept, value.alias("_in"))
    return staged.mapInArrow(run, T.StructType([df.schema[name] for name in kept] + added.fields))
