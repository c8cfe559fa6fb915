import hashlib
import re

import pytest

from lorekeep.llm import decontaminate as D
from tests.llm.conftest import odd_rows, same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {at: at + 32 for at in range(65, 91)}


def brute(rows, items):
    windows = {}
    for name, text in items:
        words = WORD.findall((text or "").translate(LOW))
        m = min(10, len(words))
        for at in range(len(words) - m + 1 if m else 0):
            windows.setdefault(tuple(words[at : at + m]), set()).add("" if name is None else str(name))
    for name, text in rows:
        words = WORD.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for m in {len(window) for window in windows}:
            for at in range(len(words) - m + 1):
                if tuple(words[at : at + m]) in windows:
                    hit |= set(range(at, at + m))
                    found |= windows[tuple(words[at : at + m])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield name, len(words), len(hit), len(found), digest, bool(hit)


@pytest.fixture(scope="module")
def items(spark):
    passage = odd_rows()[5][1]
    rows = [(1, passage, "x"), (2, " ".join(passage.split()[20:45]), "x"), (3, None, "x"), (4, "", "x"), (5, "MIT, license!", "x"),
            (6, "text for an id", "x"), (None, "one", "x"), (2, " ".join(passage.split()[20:45]), "x"), (10, "İ ΑΣ k", "x")]
    return spark.createDataFrame(rows, "item_id long, text string, key string")


def test_hard_cases(odd, items):
    want = list(brute([row[:2] for row in odd_rows()], [tuple(row)[:2] for row in items.collect()]))
    assert sum(row[5] for row in want) > 6
    same(D.report(odd, items).collect(), want)


def test_without_broadcast(odd, items, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_RUNS", 0)
    same(D.report(odd, items).collect(), brute([row[:2] for row in odd_rows()], [tuple(row)[:2] for row in items.collect()]))


def test_empty_tables(odd, none, items):
    assert D.report(none, items).collect() == []
    assert D.report(odd, items.limit(0)).filter("contaminated or n_hit > 0 or n_items > 0").count() == 0
    assert D.decontaminated(odd, items.limit(0)).count() == odd.count()


def test_removal(odd, items):
    clean = D.decontaminated(odd, items)
    assert clean.columns == odd.columns
    assert clean.count() == D.report(odd, items).filter("not contaminated").count()
    cut = D.decontaminated(odd, items, "spans")
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert D.report(cut, items).filter("contaminated").count() == 0


def test_cut_texts(spark):
    docs = spark.createDataFrame([(1, "Start. One two, THREE! End"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    same(D.decontaminated(docs, items, "spans").collect(), [(1, "Start. End"), (2, None)])


def test_one_scan_for_all_lengths(spark, tmp_path):
    """Items of many lengths: texts are read and cut once; windows at both ends, over marks, and by short runs are found."""
    words = "Aa b1, ΑΣ'k é—x (c) d_e 7 -- İ ß".split(" ")
    texts = [" ".join(words[at:] + words[:at]) + end for at in range(len(words)) for end in ("", " .", " a b1")] + ["", " ,", "é" * 3000, "a b " * 200]
    rows = list(enumerate(texts))
    items = [(n, " ".join(words[n % 7 :][:n])) for n in range(12)] + [(12, " ".join(words * 2)), (13, "b a b a b"), (14, "7 i"), (None, "a b a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs, held = spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame(items, "item_id long, text string")
    want = list(brute(rows, items))
    assert len({m for m in range(1, 11) if any(len(WORD.findall(text)) == m for _, text in items)}) > 5
    same(D.report(docs, held).collect(), want)
    plan = D.hits(docs, held)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_marks_without_ranges():
    """A class of ranges is looked up range by range, which took most of the time."""
    assert not re.search(r"(?<!\\)-", D.MIXED) and D.MIXED.startswith("[^")
    assert [chr(code) for code in range(128) if re.match(D.MIXED, chr(code))] == [chr(code) for code in range(128) if chr(code).isalnum()]
