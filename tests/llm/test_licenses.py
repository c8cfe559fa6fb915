import re

from lorekeep.llm import licenses as L
from tests.llm.conftest import odd_rows, same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall((text or "").translate({at: at + 32 for at in range(65, 91)}))
    places, labels = [], set()
    for label, phrase in L.PHRASES.items():
        phrase = phrase.split()
        for at in range(len(words)):
            if words[at : at + len(phrase)] == phrase:
                places.append(at)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


CASES = ["MIT License; mit\nlicense, the MIT licenses", "GNU General Public License v3", "Éé mit-license apache -- LICENSE é", "mitlicense mit licence"]


def test_base(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = L.license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    same(got, [(at, *brute(text)) for at, text in enumerate(CASES)])


def test_hard_cases(odd):
    rows = L.license_scan(odd)
    same(rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect(), [(row[0], *brute(row[1])) for row in odd_rows()])
    for row in rows.collect():
        assert 0 <= row.score <= 1 and set(row.base_labels.split(",")) <= set(row.labels.split(","))


def test_no_rows(none):
    assert L.license_scan(none).collect() == []


def test_inner_detections_are_suppressed():
    found = L.detections("licensed under the apache license, version 2.0")
    assert [(x.label, x.start, x.end) for x in found] == [("apache-2.0", 0, 46)]
    assert [x.label for x in L.detections("licensed under cc by-nc 4.0. all rights reserved.")] == ["cc-by-nc-4.0", "proprietary"]


def test_rules():
    rules = L.rules()
    assert len(rules) > 200 and [rule.priority for rule in rules] == sorted((rule.priority for rule in rules), reverse=True)
    for label, form in (("mit", "spdx-license-identifier: mit"), ("mpl-2.0", "mozilla public license 2.0"), ("isc", "released under the isc license")):
        assert label in {x.label for x in L.detections(form)}


def test_notices_are_found_wrapped_and_prefixed():
    notices = (
        ("apache-2.0", "licensed under the apache license, version 2.0"),
        ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy"),
        ("bsd", "redistribution and use in source and binary forms"),
        ("gpl", "you can redistribute it and/or modify it under the terms of the gnu general public license"),
        ("ofl-1.1", "sil open font license"),
        ("cc-by-sa-4.0", "cc by-sa 4.0"),
    )
    for label, notice in notices:
        plain = [(x.label, x.priority) for x in L.detections(notice)]
        assert label in {name for name, _ in plain}
        for gap in ("\n", "  ", "\t", "\r\n * ", "\n// ", "\n# ", "\n;; ", " *\n *\n * ", "\n> "):
            text = notice.replace(" ", gap)
            found = L.detections(text)
            assert [(x.label, x.priority) for x in found] == plain, (gap, found)
            assert min(x.start for x in found) == 0 and max(x.end for x in found) == len(text)
    assert L.detections("licensed under\n * nothing apache") == []
