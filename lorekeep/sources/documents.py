"""Document sources."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lorekeep.functions import text as tx
from lorekeep.session import materialise, shared_file

# Files in a folder that ``write_text_files`` makes.
FOLDER_FILES = 1000
# Files, or bytes of files, that a task reads, and those of an Arrow batch.
TASK_FILES, TASK_BYTES = 4000, 64 << 20
BATCH_FILES, BATCH_BYTES = 512, 4 << 20
# Names that are left to Spark's reader: files it unpacks, and names that are no text.
_SPECIAL = re.compile("[\ud800-\udfff]|[.](gz|bz2|deflate|lz4|snappy|zst|zstd|passthrough)$")


def read_markdown(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """``doc_key, source, text``: the files directly in ``path`` that match, blank ones left out.

    ``path`` may be a pattern of folders. Local folders, or those of a mount that all machines have, are listed and read by tasks, so
    that the driver does not hold a file's name; other stores, folders named like partitions and packed files are left to
    Spark's reader, whose driver holds them all.
    """
    places = _listed(spark, path, pattern)
    if places is not None:
        files = places.mapInArrow(_read_files, "_name string, value binary")
        named = files.select("_name", F.col("value").cast("string").alias("value"))
    else:
        files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
        # The file metadata is URI-encoded; a plus sign is not an encoded space there.
        encoded = F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B")
        named = files.select(F.url_decode(encoded).alias("_name"), "value")
    named = named.select("_name", F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    return named.filter(~tx.is_blank(F.col("text"))).select(
        F.col("_name").alias("doc_key"), F.concat(F.lit("file:"), F.col("_name")).alias("source"), "text"
    )


def _hidden(name: str) -> bool:
    """Whether Spark passes over a file or folder of this name."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(root: str, accepted: re.Pattern) -> Iterator[tuple[str | None, int]]:
    """Path and size of each file directly in ``root``, or of itself; without a path, where only Spark's reader will do."""

    def fail(error: OSError) -> None:
        raise error

    if not os.path.isdir(root):
        tree = [(os.path.dirname(root), [], [os.path.basename(root)])]
    else:
        tree = os.walk(root, onerror=fail)
    for depth, (folder, folders, names) in enumerate(tree):
        folders[:] = [name for name in folders if not _hidden(name)]
        if any("=" in name for name in folders):
            yield None, 0
        for name in names if not depth else ():
            if _hidden(name) or not accepted.fullmatch(name):
                continue
            if _SPECIAL.search(name):
                yield None, 0
                continue
            try:
                yield os.path.join(folder, name), os.path.getsize(os.path.join(folder, name))
            except FileNotFoundError:
                pass  # a link to nowhere


def _listed(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """``place``: the files to read, dealt to tasks; None where only Spark's reader will do."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        return None
    roots = [(found.getPath().toUri().getPath(),) for found in store.globStatus(place) or ()]
    if not roots:
        return None
    wanted = hadoop.GlobPattern(pattern).compiled().pattern()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepted = re.compile(wanted, re.DOTALL)
        schema = pa.schema([("place", pa.string()), ("size", pa.int64())])
        for batch in batches:
            for root in batch.column("root").to_pylist():
                entries = _entries(root, accepted)
                while part := list(islice(entries, TASK_FILES)):
                    places, sizes = zip(*part)
                    yield pa.RecordBatch.from_arrays([pa.array(places, pa.string()), pa.array(sizes, pa.int64())], schema=schema)

    # Listed once, so that what is read does not change.
    found = materialise(spark.createDataFrame(roots, "root string").mapInArrow(run, "place string, size long"))
    n, size, special = found.agg(F.count("place"), F.sum("size"), F.count(F.when(F.col("place").isNull(), 1))).first()
    if special:
        return None
    tasks = max(1, -(-n // TASK_FILES), -(-(size or 0) // TASK_BYTES))
    return found.select("place").repartition(tasks, "place")


def _read_files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_name, value``: the files' names and bytes."""
    names: list[str] = []
    values: list[bytes] = []
    size = 0

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary())], names=["_name", "value"])

    for batch in batches:
        for place in batch.column("place").to_pylist():
            with open(place, "rb") as file:
                values.append(file.read())
            names.append(os.path.basename(place))
            size += len(values[-1])
            if size >= BATCH_BYTES or len(names) >= BATCH_FILES:
                yield batch_of()
                names, values, size = [], [], 0
    if names:
        yield batch_of()


def markdown_stream(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """The same rows as a stream of newly arriving files."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", pattern)
    encoded = F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B")
    named = files.load(path).select(
        F.url_decode(encoded).alias("_name"),
        F.regexp_replace("value", "\r\n?", "\n").alias("text"),
    )
    return named.filter(~tx.is_blank(F.col("text"))).select(
        F.col("_name").alias("doc_key"), F.concat(F.lit("file:"), F.col("_name")).alias("source"), "text"
    )


def write_text_files(rows: DataFrame, path: str) -> int:
    """Every ``text`` as a file of its own, ``FOLDER_FILES`` of a task to a folder ``folder=<task>-<number>``; how many there are.

    Tasks write where the rows are, so nothing is moved and no folder is made for a single file. A task that is repeated
    writes the same files again. Null texts are empty files.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task, n, store = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for text in batch.column("text"):
                folder = f"{path}/folder={task}-{n // FOLDER_FILES}"
                if n % FOLDER_FILES == 0:
                    store, place = shared_file(folder)
                    store.create_dir(place, recursive=True)
                name = f"{place}/{n}.txt"
                local = isinstance(store, fs.LocalFileSystem)
                with open(name, "wb") if local else store.open_output_stream(name, compression=None) as file:
                    file.write((text.as_py() or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.select("text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def notes_to_docs(notes: DataFrame, source: str = "chat") -> DataFrame:
    """Documents from ``note_id, information, context`` rows."""
    return notes.select(
        F.col("note_id").cast("string").alias("doc_key"),
        F.lit(source).alias("source"),
        tx.note_text(F.col("information"), F.col("context")).alias("text"),
    )
