"""Small documents that hold every hard case: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, n_words string, _key string"


def odd_rows():
    words = random.Random(5)
    prose = lambda n: " ".join("".join(words.choice("abcdeé") for _ in range(words.randint(1, 6))) for _ in range(n))
    passage = prose(60)
    texts = [
        None, "", " \n\t ", "one", "two words", passage, passage, passage + " " + prose(30), prose(30) + "\n" + passage,
        prose(3000), "a" * 5000, "9" * 4000, "a\n" * 300, "A.B@c.de and 10.0.0.1, +49 30 1234567", "é😀 ü x\x1cy <|endoftext|>",
        "MIT License. Licensed under the Apache License, Version 2.0.", "#$%& * | <x>", passage.upper(),
    ]
    ids = [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17]
    sources = [None, "a", "b", "", "é", "a", "a", "a", "a", "b", "b", None, "z", "z", "a", "b", "a", "a"]
    rows = [(i, t, None, s, None, "k", "w", "x") for i, t, s in zip(ids, texts, sources)]
    # A row that is there twice, an id with two texts, a null id more.
    return rows + [rows[5], rows[5], (7, "another text for an id that is taken", "en", "b", 3, None, None, None), (None, passage, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)


def same(got, want):
    """Equal rows in any order."""
    order = lambda row: tuple((value is None, str(value)) for value in row)
    got, want = sorted(map(tuple, got), key=order), sorted(map(tuple, want), key=order)
    assert got == want
