import random

import pytest

from lorekeep.llm import tokens as T
from tests.llm.conftest import odd_rows, same

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "1", "42", "!", "...", "the", "<|endoftext|>", "\x1c", "\x85",
          "　", " ", "日本", "😀", "A", " t", "½", "́", "\x00", "tokenization", "    "]


@pytest.mark.parametrize("chunk", [7, T.CHUNK])
def test_against_the_library(library, chunk, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", chunk)
    draw, count = random.Random(chunk), T.counter(PATH).count
    for _ in range(1500):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 40)))
        assert count(text) == library(text), text


def test_tables_may_start_anew(library, monkeypatch):
    monkeypatch.setattr(T, "STATES", 50)
    monkeypatch.setattr(T, "REMEMBERED", 5)
    machine = T.Counter(PATH)
    for text in ("some words that make states", "and others: unbelievable!", "some words again"):
        assert machine.count(text) == library(text)


def test_hard_cases(odd, library):
    want = [
        (row[0], len((row[1] or "").encode()), library(row[1]), library(row[1]) > 512) for row in odd_rows()
    ]
    same(T.token_counts(odd, PATH).collect(), want)


def test_no_rows(none):
    assert T.token_counts(none, PATH).collect() == []
