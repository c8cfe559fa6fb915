"""Token ids of whole documents in files of fixed-width codes.

Every id takes the least number of bits that the vocabulary needs. Ids are packed in blocks of one size, whose
byte offsets stand in the file's footer with the documents' bounds, so that any range of ids is read by opening only
its blocks and unpacking them in numpy. A file::

    magic | packed blocks | footer: block offsets u64, document starts u64, document ids as an Arrow stream | trailer

Files are written by tasks under names of their own and named by an index table; files of lost attempts are
never named, so nobody reads them. The library is given each distinct stretch between white space once per task:
its patterns never match across white space, so the ids are those of the whole text.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

MAGIC = b"BITPACK1"
_TRAILER = struct.Struct("<QQQQII8s")  # footer start, ids, blocks, documents, bits of an id, ids of a block, magic
# Ids of a block: a multiple of 8, so that every block begins at a byte.
BLOCK_IDS = 1 << 14
# Packed bytes after which a file is closed; a document lies in one file whatever its length.
FILE_BYTES = 64 << 20
# Distinct stretches a task remembers, of which it keeps the first half when they are that many, and the longest of them.
WORDS = 1 << 19
LONG = 1 << 10
_COUNT = 24  # bits for the number of ids of a stretch
_PIECE = 1 << 20  # characters after which a text may be cut
_TOGETHER = 1 << 23  # characters that are looked up at once
# Rows looked at for the bounds of the sort; they only decide how evenly tasks are filled.
SAMPLE = 1 << 17
_GAP = re.compile(r"[\t\n\x0b\x0c\r ]")
# Digits are tokens of their own, so a stretch without white space may be cut before one.
_BEFORE_DIGIT = re.compile(r"(?<=[A-Za-z0-9+/=])(?=[0-9])")
# A letter ends its run before any other ASCII character, and nothing composes with the letters behind that.
_AFTER_LETTERS = r"([A-Za-z])([!-@\[-`{-~])"
# Marks that compose with ASCII letters, some of them only with small ones.
_MARKS = r"[\x{0300}-\x{036f}]"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as codes of ``width`` bits, the lowest bit first; the last byte is filled with zeros."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(ids, f"<u{width // 8}").tobytes()
    out = []
    for start in range(0, len(ids), BLOCK_IDS):
        part = np.ascontiguousarray(ids[start : start + BLOCK_IDS], "<u4")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """The ``n`` ids that ``pack`` has stored."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    out = np.empty(n, np.uint32)
    step = BLOCK_IDS * width // 8
    for at, start in enumerate(range(0, n, BLOCK_IDS)):
        count = min(BLOCK_IDS, n - start)
        part = np.frombuffer(data, np.uint8, min(step, len(data) - at * step), at * step)
        bits = np.unpackbits(part, count=count * width, bitorder="little").reshape(count, width)
        whole = np.zeros((count, 32), np.uint8)
        whole[:, :width] = bits
        out[start : start + count] = np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()
    return out


@lru_cache(maxsize=2)
def _tokenizer(definition: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


class Encoder:
    """Ids of whole texts; every distinct stretch between white space goes through the library once.

    Holds for tokenizers that drop white space and whose normalizer and patterns do not reach across it, such as
    lower-casing ones with word ends.
    """

    def __init__(self, definition: str) -> None:
        self.library = _tokenizer(definition)
        normalizer, cutter = self.library.normalizer, self.library.pre_tokenizer
        self.lower = bool(normalizer) and normalizer.normalize_str("aZ") == "az"
        # Small ASCII letters reach the merges as they are, so these can be asked at once.
        self.plain = (
            bool(normalizer and cutter)
            and normalizer.normalize_str(_LETTERS) == _LETTERS
            and [piece for piece, _ in cutter.pre_tokenize_str(_LETTERS)] == [_LETTERS]
        )
        # Where a stretch's ids begin in the pool, and in the lowest bits how many they are.
        self.places: dict[str, int] = {"": 0}
        self.pool = array("I")

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        if len(self.places) + len(words) > WORDS:
            # What was met first is what is met most often.
            self.places = dict(islice(self.places.items(), WORDS // 2))
            del self.pool[max(at + n for at, n in map(self._span, self.places.values())) :]
        merges = self.library.model.tokenize
        for word in words:
            if self.plain and word.isascii() and word.isalpha() and word.islower():
                ids = [token.id for token in merges(word)]
            else:
                ids = self.whole(word)
            self.places[word] = len(self.pool) << _COUNT | len(ids)
            self.pool.extend(ids)

    @staticmethod
    def _span(place: int) -> tuple[int, int]:
        return place >> _COUNT, place & ((1 << _COUNT) - 1)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Texts are looked up together, long ones in pieces cut at white space."""
        pieces, owners, held, out = [], [], 0, [[] for _ in texts]
        for owner, text in enumerate(texts):
            at = 0
            while at < len(text):
                cut = _GAP.search(text, at + _PIECE)
                end = cut.start() if cut else len(text)
                pieces.append(text[at:end])
                owners.append(owner)
                held, at = held + end - at, end
                if held >= _TOGETHER:
                    self._collect(pieces, owners, out)
                    pieces, owners, held = [], [], 0
        self._collect(pieces, owners, out)
        return [np.concatenate([np.empty(0, np.uint32), *parts]) for parts in out]

    def _collect(self, pieces: list[str], owners: list[int], out: list[list[np.ndarray]]) -> None:
        if not pieces:
            return
        column = pa.array(pieces, pa.large_string())
        # Not where a special token's string may be cut, nor where a mark makes a letter's case matter.
        free = pc.invert(pc.or_(pc.match_substring(column, "<|"), pc.match_substring_regex(column, _MARKS)))
        cut = pc.replace_substring_regex(column, pattern=_AFTER_LETTERS, replacement=r"\1 \2")
        column = pc.if_else(free, pc.ascii_lower(cut) if self.lower else cut, column)
        lists = pc.ascii_split_whitespace(column)
        bounds = np.asarray(lists.offsets)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        long = np.flatnonzero(np.asarray(pc.utf8_length(coded.dictionary)) > LONG).tolist()
        flat, counts = self._looked_up(words, long, np.asarray(coded.indices))
        ends = np.concatenate([[0], np.cumsum(counts)])[bounds - bounds[0]]
        for owner, start, end in zip(owners, ends[:-1].tolist(), ends[1:].tolist()):
            out[owner].append(flat[start:end])

    def _looked_up(self, words: list[str], long: list[int], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in ``order``, one behind the other, and how many each has; ``long`` are not remembered."""
        found_long = {at: self._long(words[at]) for at in long}
        for at in long:
            words[at] = ""
        found = list(map(self.places.get, words))
        while None in found:  # twice at most: what is looked up at once fits into half of what is remembered
            self._learn([word for word, place in zip(words, found) if place is None])
            found = list(map(self.places.get, words))
        places = np.array(found, np.int64)
        starts, n = places >> _COUNT, places & ((1 << _COUNT) - 1)
        pool = np.frombuffer(self.pool, np.uint32) if self.pool else np.empty(0, np.uint32)
        for at, ids in found_long.items():
            starts[at], n[at] = len(pool), len(ids)
            pool = np.concatenate([pool, ids])
        counts = n[order]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return pool[np.repeat(starts[order] - (ends - counts), counts) + np.arange(total)], counts

    def _long(self, word: str) -> np.ndarray:
        """Ids of a long stretch, in pieces that begin at digits, of about 64 K characters where there are digits."""
        ids, at = array("I"), 0
        while len(word) - at > 1 << 16 and (cut := _BEFORE_DIGIT.search(word, at + (1 << 16))):
            ids.extend(self.whole(word[at : cut.start()]))
            at = cut.start()
        ids.extend(self.whole(word[at:]))
        return np.frombuffer(ids, np.uint32)


def _filesystem(path: str):
    """The store behind a path or URI that all executors reach, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Writer:
    """One file, block by block; holds a block and the documents' bounds."""

    def __init__(self, folder: str, name: str, width: int) -> None:
        self.store, self.folder = _filesystem(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.name, self.width = name, width
        self.out = self.store.open_output_stream(f"{self.folder}/{name}")
        self.out.write(MAGIC)
        self.offsets, self.starts, self.names = [len(MAGIC)], [0], []
        self.open: list[np.ndarray] = []
        self.n_open = 0

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def add(self, name: object, ids: np.ndarray) -> None:
        self.names.append(name)
        self.starts.append(self.starts[-1] + len(ids))
        self.open.append(ids)
        self.n_open += len(ids)
        if self.n_open >= BLOCK_IDS:
            whole = np.concatenate(self.open)
            full = len(whole) - len(whole) % BLOCK_IDS
            for at in range(0, full, BLOCK_IDS):
                self._block(whole[at : at + BLOCK_IDS])
            self.open, self.n_open = [whole[full:]], len(whole) - full

    def close(self, kind: pa.DataType) -> tuple[str, int, int]:
        if self.n_open:
            self._block(np.concatenate(self.open))
        self.out.write(np.array(self.offsets, "<u8").tobytes() + np.array(self.starts, "<u8").tobytes())
        table = pa.table({"doc_id": pa.array(self.names, kind)})
        with pa.ipc.new_stream(held := pa.BufferOutputStream(), table.schema) as stream:
            stream.write_table(table)
        self.out.write(held.getvalue())
        blocks = len(self.offsets) - 1
        self.out.write(_TRAILER.pack(self.offsets[-1], self.starts[-1], blocks, len(self.names), self.width, BLOCK_IDS, MAGIC))
        self.out.close()
        return self.name, len(self.names), self.starts[-1]


class PackedFile:
    """Random access to a written file: ids by number, documents by place."""

    def __init__(self, folder: str, name: str) -> None:
        store, folder = _filesystem(folder)
        self.source = store.open_input_file(f"{folder}/{name}")
        size = self.source.size()
        tail = self.source.read_at(_TRAILER.size, size - _TRAILER.size)
        footer, self.n_ids, blocks, self.n_docs, self.width, self.block_ids, magic = _TRAILER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{name} is not a file of packed ids")
        data = self.source.read_at(size - _TRAILER.size - footer, footer)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, 8 * (blocks + 1)).astype(np.int64)
        names = pa.py_buffer(data)[8 * (blocks + 1) + 8 * (self.n_docs + 1) :]
        self.names = pa.ipc.open_stream(names).read_all().column("doc_id").combine_chunks()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from number ``start`` up to ``stop``; only their blocks are read."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, -(-stop // self.block_ids)
        at, end = int(self.offsets[first]), int(self.offsets[last])
        # Every block but the last is full, so blocks that stand together unpack as one.
        count = min(last * self.block_ids, self.n_ids) - first * self.block_ids
        found = unpack(self.source.read_at(end - at, at), count, self.width)
        return found[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, place: int) -> np.ndarray:
        return self.ids(int(self.starts[place]), int(self.starts[place + 1]))

    def close(self) -> None:
        self.source.close()

    def __enter__(self) -> PackedFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


@lru_cache(maxsize=1)
def _encoder(definition: str) -> Encoder:
    return Encoder(definition)


def _bounds(docs: DataFrame, width: int, file_bytes: int) -> list[tuple]:
    """Keys ``(doc_id, tie, row)`` at which the sort's tasks begin, from a sample of bounded size."""
    total = docs.count()
    # At most SAMPLE rows reach the driver, up to chance; rows that are not drawn are sorted all the same.
    drawn = docs.sample(min(1.0, SAMPLE / max(total, 1)), seed=11)
    rows = drawn.select("doc_id", "tie", "row", F.octet_length("text").alias("size")).collect()
    keys = sorted(map(_key, rows))
    # Four bytes of text make about one id.
    wanted = sum(row["size"] or 0 for row in rows) * total * width // (max(len(rows), 1) * 32 * file_bytes) + 1
    parts = min(wanted, max(1, len(keys) // 8))
    return sorted({keys[at * len(keys) // parts] for at in range(1, parts)})


def _key(row) -> tuple:
    """Order of documents: null ids first, then by id, by a hash of the text, by place in the input."""
    name = row["doc_id"]
    return (name is not None, 0 if name is None else name, row["tie"], row["row"])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts are looked up together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + _TOGETHER, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def encoded(docs: DataFrame, definition: str, width: int, end_id: int, bounds: list[tuple]) -> DataFrame:
    """``doc_id, tie, row, part, n, packed``: the ids of the whole text and the end id, and the task that sorts them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition)
        for batch in batches:
            for rows in _slices(batch):
                ids = encoder.encode([text or "" for text in rows.column("text").to_pylist()])
                keys = map(_key, rows.select(["doc_id", "tie", "row"]).to_pylist())
                columns = {name: rows.column(name) for name in ("doc_id", "tie", "row")}
                columns["part"] = pa.array([bisect_right(bounds, key) for key in keys], pa.int32())
                columns["n"] = pa.array([len(found) + 1 for found in ids], pa.int64())
                columns["packed"] = pa.array([pack(np.append(found, np.uint32(end_id)), width) for found in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, f"doc_id {kind}, tie long, row long, part int, n long, packed binary")


_FILES = "part long, place long, file string, n_docs long, n_ids long"


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of ``docs`` (``doc_id, text``) below ``folder`` and return the index of its files.

    ``folder`` is one that all executors reach, by path or URI; ``tokenizer`` is a file of the tokenizers library,
    read by the driver. Documents stand in ascending order of ``doc_id``, null first; documents of the same id
    follow by a hash of their texts. The index, also written to ``folder/index``, has a row for each file:
    ``part, place, file, n_docs, n_ids, start``, where ``start`` counts the ids of all files before. Null texts
    are empty: their only id is the end id. Rows that repeat are written as often. No rows give an empty index.
    Other columns are left behind.
    """
    spark = docs.sparkSession
    definition = Path(tokenizer).read_text()
    width = max(_tokenizer(definition).get_vocab_size() - 1, end_id, 1).bit_length()
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), "text")
    # The sort's bounds come from a sample of the keys, so that ids need neither be encoded twice nor be stored before.
    bounds = _bounds(rows, width, file_bytes)
    kind = rows.schema["doc_id"].dataType

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        part, place, writer = None, 0, None

        def closed() -> pa.RecordBatch:
            name, n_docs, n_ids = writer.close(to_arrow_type(kind))
            return pa.RecordBatch.from_pylist([{"part": part, "place": place, "file": name, "n_docs": n_docs, "n_ids": n_ids}])

        for batch in batches:
            for own, name, n, packed in zip(*(batch.column(x) for x in ("part", "doc_id", "n", "packed"))):
                if own.as_py() != part:
                    if writer:
                        yield closed()
                    part, place, writer = own.as_py(), 0, None
                # A name for this attempt alone.
                writer = writer or _Writer(f"{folder}/ids", f"{part:06d}-{place:04d}-{uuid.uuid4().hex}.bits", width)
                writer.add(name.as_py(), unpack(packed.as_py(), n.as_py(), width))
                if writer.starts[-1] * width >= 8 * file_bytes:
                    yield closed()
                    writer, place = None, place + 1
        if writer:
            yield closed()

    order = ["part", "doc_id", "tie", "row"]
    dealt = encoded(rows, definition, width, end_id, bounds).repartitionById(len(bounds) + 1, "part")
    files = dealt.sortWithinPartitions(*order).select("part", "doc_id", "n", "packed").mapInArrow(write, _FILES)
    files.write.parquet(f"{folder}/files")
    # One row a file, of 64 MB and more except for the last of each task.
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.parquet(f"{folder}/files")
    index = files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    index.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read_documents(spark: SparkSession, folder: str, kind: str = "bigint", with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files of ``folder``, read back by their blocks.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is the unsigned checksum of the ids as
    little-endian 32-bit integers. ``kind`` is the type of ``doc_id``; ``with_ids`` adds the ids themselves.
    """
    index = spark.read.parquet(f"{folder}/index")
    tasks = max(1, min(index.count(), 10_000))
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with PackedFile(f"{folder}/ids", row["file"]) as found:
                    yield from _documents(found, row["start"], with_ids)

    return index.select("file", "start").repartition(tasks, "file").mapInArrow(read, schema)


def _documents(found: PackedFile, start: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a file's documents; runs of documents that fill a few blocks are read at once."""
    place = 0
    while place < found.n_docs:
        stop = int(np.searchsorted(found.starts, found.starts[place] + 64 * found.block_ids, "right")) - 1
        stop = min(max(stop, place + 1), found.n_docs)
        bounds = found.starts[place : stop + 1] - found.starts[place]
        ids = found.ids(int(found.starts[place]), int(found.starts[stop])).astype("<u4")
        parts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        columns = {
            "doc_id": found.names.slice(place, stop - place),
            "start": pa.array(start + found.starts[place:stop]),
            "n_tokens": pa.array(np.diff(bounds)),
            "ids_crc32": pa.array([zlib.crc32(part.tobytes()) for part in parts], pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array([part.astype(np.int64) for part in parts], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict(columns)
        place = stop


def token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` with ``write_ids`` and read every document back from the files."""
    write_ids(docs, folder, tokenizer, end_id)
    return read_documents(docs.sparkSession, folder, docs.schema["doc_id"].dataType.simpleString())
