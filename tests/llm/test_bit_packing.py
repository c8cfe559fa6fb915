import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorekeep.llm import bit_packing as B

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return B.Encoder(open(FILE).read())


def expected(rows, library):
    """Every document's row, document by document in plain Python."""
    out, start = [], 0
    key = lambda row: (row[0] is not None, row[0] or 0)
    for name, text in sorted(rows, key=key):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 31, 32])
def test_round_trip_of_codes(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 2 * B.BLOCK_IDS + 77, dtype=np.uint64).astype(np.uint32)
    packed = B.pack(ids, width)
    assert len(packed) == -(-len(ids) * width // 8)
    assert np.array_equal(B.unpack(packed, len(ids), width), ids)
    assert len(B.unpack(b"", 0, width)) == 0


def test_ids_are_those_of_the_whole_text(encoder):
    draw = random.Random(3)
    alphabet = "aB1é'́ \t\n\x0b\x0c\r\x1c\x85\xa0　한漢😀ßΣσIİKJ\u030c\u0307ǰ<|>.,-9"
    for k in range(5000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40)))
        text += draw.choice(["", "", "it's", "<|endoftext|>", " <|startoftext|>x", "<|ENDOFTEXT|>", "Don'T "]) + text[::-1]
        assert np.array_equal(encoder.encode([text])[0], encoder.whole(text)), repr(text)


@pytest.mark.parametrize("name, value", [("LONG", 8), ("WORDS", 250), ("_PIECE", 32)])
def test_ids_do_not_depend_on_bounds(monkeypatch, name, value):
    monkeypatch.setattr(B, name, value)
    encoder, draw = B.Encoder(open(FILE).read()), random.Random(4)
    for _ in range(300):
        text = "".join(draw.choice("ab1 9Zé+/='ś\n") for _ in range(draw.randint(0, 200)))
        assert np.array_equal(encoder.encode([text])[0], encoder.whole(text)), repr(text)


def test_very_long_texts(encoder):
    for text in ("Ab1+" * 300_000, "one two. " * 200_000, "x" * 100_000):
        assert np.array_equal(encoder.encode([text])[0], encoder.whole(text))


def test_files_hold_every_document(spark, odd, tmp_path):
    # One text an id, so that the order is known.
    docs = odd.groupBy("doc_id").agg(F.max("text").alias("text"))
    got = B.token_files(docs, str(tmp_path / "files"), FILE, 2)
    want = expected([(r.doc_id, r.text) for r in docs.collect()], Tokenizer.from_file(FILE))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_repeated_rows_and_ids_are_all_written(spark, odd, tmp_path):
    got = B.token_files(odd, str(tmp_path / "files"), FILE, 2).orderBy("start").collect()
    assert len(got) == odd.count()
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    encode = Tokenizer.from_file(FILE).encode
    lengths = sorted((r.doc_id or 0, len(encode(r.text or "", add_special_tokens=False).ids) + 1) for r in odd.collect())
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == lengths


def test_random_access_and_small_files(spark, tmp_path):
    docs = spark.createDataFrame([(f"k{at:04d}", f"word{at} " * (at % 50)) for at in range(600)], "doc_id string, text string")
    folder = str(tmp_path / "files")
    index = B.write_ids(docs, folder, FILE, 2, file_bytes=4096)
    assert index.count() > 5 and index.agg(F.sum("n_docs")).first()[0] == 600
    rows = {r.doc_id: r for r in B.read_documents(spark, folder, "string", with_ids=True).collect()}
    assert len(rows) == 600 and all(r.ids[-1] == 2 for r in rows.values())
    for entry in index.collect():
        with B.PackedFile(f"{folder}/ids", entry.file) as one:
            assert one.width == 16 and one.n_ids == entry.n_ids
            place = one.n_docs // 2
            name = one.names[place].as_py()
            assert one.document(place).tolist() == rows[name].ids
            assert rows[name].start == entry.start + one.starts[place]
            assert one.ids(3, 8).tolist() == one.ids(0, one.n_ids)[3:8].tolist()


def test_blocks_across_a_long_document(tmp_path):
    writer = B._Writer(str(tmp_path), "one.bits", 13)
    long = np.random.default_rng(1).integers(0, 1 << 13, 3 * B.BLOCK_IDS + 5).astype(np.uint32)
    for name, ids in ((1, long[:7]), (2, long), (None, long[:1])):
        writer.add(name, ids)
    import pyarrow as pa

    assert writer.close(pa.int64())[1:] == (3, len(long) + 8)
    with B.PackedFile(str(tmp_path), "one.bits") as one:
        assert np.array_equal(one.document(1), long) and one.names.to_pylist() == [1, 2, None]
        for start in (0, 6, 7, B.BLOCK_IDS - 1, B.BLOCK_IDS, 2 * B.BLOCK_IDS + 3):
            assert np.array_equal(one.ids(start, start + 20), np.concatenate([long[:7], long, long[:1]])[start : start + 20])


def test_no_rows(spark, none, tmp_path):
    assert B.token_files(none, str(tmp_path / "files"), FILE, 2).count() == 0
