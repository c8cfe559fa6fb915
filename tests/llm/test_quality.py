from collections import Counter

from lorekeep.llm import quality as Q
from tests.llm.conftest import odd_rows, same


def brute(text):
    words = (text or "").encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    places = {at + k for at, window in enumerate(zip(words, words[1:], words[2:])) if windows[window] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    chars = sum(len(word.decode()) for word in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(places)


def test_hard_cases(odd):
    rows = Q.quality_rules(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = []
    for row in odd_rows():
        found = brute(row[1])
        want.append((row[0], *found, found[0] < 50 or 100 * found[4] > 50 * found[0]))
    same(rows, want)


def test_no_rows(none):
    assert Q.quality_rules(none).collect() == [] and Q.keep_good(none).collect() == []


def test_keeping_agrees_with_the_verdicts(odd):
    kept = Q.keep_good(odd)
    assert kept.columns == odd.columns
    assert kept.count() == Q.quality_rules(odd).filter("kept").count()


def test_bad_hosts_lose_doubtful_documents_only(spark):
    good = " ".join(f"word{at}" for at in range(80))
    doubtful = " ".join(f"w{at}$$" for at in range(80))
    rows = [(at, doubtful, "bad") for at in range(20)] + [(20, good, "bad")]
    rows += [(30 + at, good, "fine") for at in range(20)] + [(50, doubtful, "fine")]
    rows += [(60, doubtful, "new")]
    kept = {r.doc_id for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("kept").collect()}
    assert kept & set(range(20)) == set() and {20, 50, *range(30, 50)} <= kept
