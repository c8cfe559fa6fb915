"""The memory store: three append-only Parquet tables under one folder.

``chunks`` keeps texts, ``questions`` keeps vectors, ``chunk_status`` is a log of attempts, so a scan
for one of them never reads the others. One writer at a time is assumed; readers are free.

Beside them stand records of one row, each kept twice and written in turn, so that the one before stays readable while the
other is written:

* ``next_id``: ids are reserved before chunks that bear them are written. A batch that is lost in between leaves ids
  that nothing has.
* ``hashed``: up to which id the hashes of chunks are in ``hashes``, a table laid out by prefix and sorted in every file. It is
  written after the chunks; what a lost batch left out is added before the next one looks hashes up. The record also names
  the folder of the table, as ``compact_hashes`` writes it anew.
* ``settled``: the counts of all chunks below an id that have their last status. They are derived from
  the log, never ahead of it, so a lost record only makes the next one read more.

Records rest on two rules of ingest: ids are given in order, and a chunk that is complete or failed stays so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from lorekeep import schemas
from lorekeep.operators.dedup import BROADCAST_KEYS
from lorekeep.operators.memory import with_status

_TABLES = {
    "chunks": schemas.CHUNKS,
    "chunk_status": schemas.CHUNK_STATUS,
    "questions": schemas.QUESTIONS,
}

_COPIES = ("even", "odd")
# Of two copies of a record the one that is larger, field by field, is the newer.
_RECORDS = {
    "next_id": "next_id long",
    "hashed": "upto long, generation int",
    "settled": "upto long, stored long, complete long, failed long",
}

_HASHES = "hash string, prefix string"
PREFIX_DIGITS = 2
# Hashes that are looked up by value, so that the scan skips row groups and pages without them.
LOOKUP_KEYS = 512
# Values of one IN that the scan still compares one by one (spark.sql.parquet.pushdown.inFilterThreshold).
_IN_VALUES = 10
# Hashes in a file of a compacted table.
HASHES_PER_FILE = 4_000_000


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str

    def _location(self, table: str) -> str:
        return f"{self.path.rstrip('/')}/{table}"

    def _read(self, table: str) -> DataFrame:
        """The table, empty when nothing was written yet."""
        try:
            return self.spark.read.schema(_TABLES[table]).parquet(self._location(table))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _TABLES[table])

    def _append(self, table: str, rows: DataFrame) -> None:
        names = self.spark.createDataFrame([], _TABLES[table]).columns
        rows.select(*names).write.mode("append").parquet(self._location(table))

    @property
    def chunks(self) -> DataFrame:
        return self._read("chunks")

    @property
    def chunk_status(self) -> DataFrame:
        return self._read("chunk_status")

    @property
    def questions(self) -> DataFrame:
        return self._read("questions")

    def chunk_texts(self, ids: DataFrame) -> DataFrame:
        """Payload of the given ``chunk_id`` rows; an unknown id has a null text."""
        return ids.join(self.chunks.select("chunk_id", "text"), "chunk_id", "left")

    def metadata(self) -> DataFrame:
        """Chunk rows without their text."""
        return self.chunks.drop("text")

    def _copies(self, record: str) -> dict[str, tuple]:
        """What the copies that can be read say; one that a lost writer left half written is passed over."""
        found = {}
        for copy in _COPIES:
            try:
                row = self.spark.read.schema(_RECORDS[record]).parquet(self._location(f"{record}/{copy}")).first()
            except AnalysisException as missing:
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
                row = None
            if row is not None:
                found[copy] = tuple(row)
        return found

    def _write_copy(self, record: str, copy: str, values: tuple) -> None:
        row = self.spark.createDataFrame([values], _RECORDS[record]).coalesce(1)
        row.write.mode("overwrite").parquet(self._location(f"{record}/{copy}"))

    def _record(self, record: str) -> tuple | None:
        return max(self._copies(record).values(), default=None)

    def _set_record(self, record: str, *values: int) -> None:
        """Write the older copy anew."""
        known = self._copies(record)
        self._write_copy(record, min(_COPIES, key=lambda copy: known.get(copy, (-1,))), values)

    def next_id(self) -> int:
        """The first id that was never reserved; reads a record of one row, and ids only of a store without one."""
        known = self._record("next_id")
        if known:
            return known[0]
        highest = self.chunks.agg(F.max("chunk_id")).first()[0]
        return 0 if highest is None else highest + 1

    def reserve(self, first: int, count: int) -> None:
        """Give away the ids from ``first`` on."""
        self._set_record("next_id", first + count)

    def _hashed(self) -> tuple[int, int]:
        return self._record("hashed") or (0, 0)

    def _hash_folder(self, generation: int) -> str:
        return self._location(f"hashes/{generation}")

    def hashes(self) -> DataFrame:
        """``hash, prefix`` of the chunks below the id in the record; a hash may be there twice."""
        folder = self._hash_folder(self._hashed()[1])
        try:
            return self.spark.read.schema(_HASHES).parquet(folder)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _HASHES)

    def _write_hashes(self, rows: DataFrame, generation: int, count: int, mode: str) -> None:
        prefixed = rows.select("hash", F.substring("hash", 1, PREFIX_DIGITS).alias("prefix"))
        # Ranges of hashes: a prefix that holds many is written by several tasks, with few a task writes several prefixes.
        ranged = prefixed.repartitionByRange(count // HASHES_PER_FILE + 1, "hash").sortWithinPartitions("prefix", "hash")
        ranged.write.mode(mode).partitionBy("prefix").parquet(self._hash_folder(generation))

    def append_hashes(self, added: DataFrame, upto: int) -> None:
        """Add the hashes of chunks that were stored, which are all the chunks from the id in the record to ``upto``."""
        before, generation = self._hashed()
        if upto > before:
            self._write_hashes(added, generation, upto - before, "append")
            self._set_record("hashed", upto, generation)

    def known_hashes(self, batch: DataFrame, rows: int) -> DataFrame:
        """The hashes among those of ``batch`` (``rows`` of them, each once) that the store holds, as ``hash``.

        Up to ``LOOKUP_KEYS`` are looked up by value: the scan opens the folders of their prefixes only, and there
        reads the pages that may hold them. More are broadcast, beyond ``BROADCAST_KEYS`` both sides are shuffled.
        """
        upto, known = self._hashed()[0], self.next_id()
        if upto < known:
            # A batch was lost before its hashes were written, or the store is older than the table.
            self.append_hashes(self.chunks.filter(F.col("chunk_id") >= upto), known)
        stored = self.hashes()
        if rows > BROADCAST_KEYS:
            return stored.join(batch.select("hash"), "hash", "left_semi").select("hash").distinct()
        if rows <= LOOKUP_KEYS:
            wanted = [value for value, in batch.select("hash").collect()]
            within = F.lit(False)
            for at in range(0, len(wanted), _IN_VALUES):
                within = within | F.col("hash").isin(wanted[at : at + _IN_VALUES])
            prefixes = sorted({value[:PREFIX_DIGITS] for value in wanted})
            return stored.filter(F.col("prefix").isin(prefixes) & within).select("hash").distinct()
        return stored.join(F.broadcast(batch.select("hash")), "hash", "left_semi").select("hash").distinct()

    def compact_hashes(self) -> None:
        """Write the table of hashes anew, each once, in few files per prefix; for stores that took many small batches.

        Readers see the new folder once the record names it; the folder before the present one is emptied the next time.
        """
        upto, generation = self._hashed()
        rows = self.hashes().select("hash").distinct()
        self._write_hashes(rows, generation + 1, upto, "overwrite")
        self._set_record("hashed", upto, generation + 1)
        if generation:
            self._clear_hashes(generation - 1)

    def _clear_hashes(self, generation: int) -> None:
        empty = self.spark.createDataFrame([], _HASHES)
        empty.write.mode("overwrite").partitionBy("prefix").parquet(self._hash_folder(generation))

    def settled(self) -> tuple[int, int, int, int]:
        """An id below which every chunk has its last status, and how many chunks below it are stored, complete, failed."""
        return self._record("settled") or (0, 0, 0, 0)

    def settle(self) -> tuple[int, int, int]:
        """Chunks stored, complete and failed in the whole store; reads chunk ids and statuses from the settled id on only.

        What has settled since is added to the record.
        """
        upto, *known = self.settled()
        end = self.next_id()
        recent = F.col("chunk_id") >= upto
        rows = with_status(self.chunks.select("chunk_id").filter(recent), self.chunk_status.filter(recent), ("status",))
        pending = F.min(F.when(F.col("status") == "pending", F.col("chunk_id")))

        def counts(where=F.lit(True)) -> list:
            return [F.count_if(where)] + [F.count_if(where & (F.col("status") == name)) for name in ("complete", "failed")]

        # Two passes over few rows: the first pending id bounds what has settled.
        first = rows.agg(pending, *counts()).first()
        settled = first[1:]
        if first[0] is not None:
            settled = rows.agg(*counts(F.col("chunk_id") < first[0])).first()
            end = first[0]
        if end > upto:
            self._set_record("settled", end, *(a + b for a, b in zip(known, settled)))
        return tuple(a + b for a, b in zip(known, first[1:]))

    def append_chunks(self, chunks: DataFrame) -> None:
        self._append("chunks", chunks)

    def append_status(self, status: DataFrame) -> None:
        if "next_try_at" not in status.columns:
            status = status.withColumn("next_try_at", F.lit(None).cast("timestamp"))
        self._append("chunk_status", status)

    def append_questions(self, questions: DataFrame) -> None:
        self._append("questions", questions)


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path)


def clear_store(spark: SparkSession, path: str) -> Store:
    """Empty all three tables and the records; ids start again at 0."""
    store = Store(spark, path)
    for generation in range(store._hashed()[1] + 1):
        store._clear_hashes(generation)
    for table, schema in _TABLES.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(store._location(table))
    for record, schema in _RECORDS.items():
        for copy in _COPIES:
            store._write_copy(record, copy, (0,) * len(schema.split(",")))
    return store
