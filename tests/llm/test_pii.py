import hashlib
import re

from lorekeep.llm import pii as P
from tests.llm.conftest import odd_rows, same

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(x) * (1 + at % 2) for at, x in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(rows):
    for name, text in rows:
        spans = []
        for rank, (kind, pattern) in enumerate(KINDS.items()):
            spans += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if valid(kind, m.group())]
        listed = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))
        counts = [sum(span[3] == kind for span in spans) for kind in KINDS]
        yield (name, *counts, hashlib.sha256(listed.encode()).hexdigest(), listed)


TRICKY = [
    "a@b.c_d@e.f x@y.z@q.w @@ a..b@c.d. éé q@w.e1 😀 z@z.zz", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 001.2.3.99999999999",
    "4111 1111 1111 1111 4111-1111-1111-1112 +49 (0)30 1234567 ü +1 2 3 +12345678901234567", "+1" + " " * 50 + "2345678901",
    "5500000000000004 5500 0000 0000 0004", "x" * 20000 + "@", "1 " * 5000,
]


def test_hard_cases(odd):
    same(P.report(odd).collect(), brute([row[:2] for row in odd_rows()]))


def test_tricky_matches(spark):
    rows = list(enumerate(TRICKY))
    same(P.report(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows))


def test_no_rows(none):
    assert P.report(none).collect() == [] and P.redacted(none).collect() == []


def test_contexts_reveal_identifiers(spark):
    seeds = [(at, f"some text, please dial +49 30 12345{at:02d} today") for at in range(12)]
    rows = [*seeds, (100, "or please dial 0171-555-0199, he said"), (101, "there are 0171-555-0199 of them")]
    spans = {row.doc_id: row.spans for row in P.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[100] == "phone:15:28" and spans[101] == ""


def test_weak_contexts_reveal_nothing(spark):
    rows = [(at, f"about the +49 30 12345{at:02d} today") for at in range(12)]
    rows += [(50 + at, f"about the 0171-555-01{at:02d} today") for at in range(12)]
    spans = P.report(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id >= 50")
    assert {row.spans for row in spans.collect()} == {""}


def test_redaction(spark):
    rows = [(1, "é x@y.z, 10.0.0.1!", 0), (2, "clean", 7), (3, None, None)]
    got = P.redacted(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()
    same(got, [(1, "é <EMAIL>, <IP>!", 16), (2, "clean", 7), (3, None, None)])
