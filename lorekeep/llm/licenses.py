"""License notices by ordered signature rules.

A rule is a regular expression with a label, a priority and a keyword. A text is searched for the keywords
first; only rules whose keyword it holds are run. Where detections overlap, one that lies inside another
of the same or a higher priority is dropped. The rules come from a table of licenses and a few forms of
speech; notices with wording of their own are written out. A space in a rule or keyword stands for any gap of white
space and comment marks, so that wrapped and prefixed lines are read as one.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm.common import map_rows

# The contract's phrases: fixed values.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
_WORD, _GAP = r"[0-9a-z\x80-\U0010ffff]", r"[^0-9a-z\x80-\U0010ffff]+"
# What a space in a rule stands for: white space, with comment marks or quotes of mail that stand by themselves.
_SPACE = r"(?:\s+(?:(?:[*#;%!|>~=+/-]+|<!--|dnl|rem)\s+)*)"

# label, keyword, name as a regular expression, place on the web (or none).
LICENSES = (
    ("mit", "mit", r"(?:the )?mit(?:[/ ]x11)?", r"opensource\.org/licenses/mit"),
    ("mit-0", "mit", r"mit[- ]0|mit no attribution", None),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e,? (?:version |v)?1\.1", None),
    ("apache-2.0", "apache", r"(?:the )?apache(?: software)?(?: licen[cs]e)?,? ?(?:version |v)?2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:simplified bsd|freebsd|bsd[- ]2[- ]clause|2[- ]clause bsd)", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:(?:new|modified|revised) bsd|bsd[- ]3[- ]clause|3[- ]clause bsd)", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:the )?(?:original bsd|bsd[- ]4[- ]clause|4[- ]clause bsd)", None),
    ("bsd", "bsd", r"(?:the )?bsd(?:[- ]style)?", None),
    ("0bsd", "bsd", r"(?:zero[- ]clause bsd|0bsd)", None),
    ("isc", "isc", r"(?:the )?isc", r"opensource\.org/licenses/isc"),
    ("gpl", "gpl", r"(?:the )?(?:gnu )?gpl", r"gnu\.org/licenses/gpl"),
    ("gpl-2.0", "gpl", r"(?:the )?(?:gnu )?gpl(?:[- ]?v?(?:ersion )?2)(?:\.0)?(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gpl", r"(?:the )?(?:gnu )?gpl(?:[- ]?v?(?:ersion )?3)(?:\.0)?(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl", "general public", r"(?:the )?(?:gnu )?general public licen[cs]e", None),
    ("lgpl-2.1", "lgpl", r"(?:the )?(?:gnu )?lgpl[- ]?v?2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lgpl", r"(?:the )?(?:gnu )?lgpl[- ]?v?3(?:\.0)?(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", "lesser general", r"(?:the )?(?:gnu )?lesser general public licen[cs]e", None),
    ("agpl-3.0", "agpl", r"(?:the )?(?:gnu )?agpl(?:[- ]?v?3(?:\.0)?)?(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl"),
    ("agpl-3.0", "affero", r"(?:the )?(?:gnu )?affero general public licen[cs]e", None),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public licen[cs]e,? (?:version |v\.? ?)?1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mozilla", r"(?:the )?mozilla public licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl-2.0", "mpl", r"mpl[- ]2(?:\.0)?", None),
    ("epl-1.0", "eclipse", r"(?:the )?eclipse public licen[cs]e(?:,? (?:- )?(?:version |v)?1\.0)", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse", r"(?:the )?eclipse public licen[cs]e(?:,? (?:- )?(?:version |v)?2\.0)?", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("cddl-1.0", "cddl", r"(?:the )?cddl(?:[- ]1\.[01])?", None),
    ("cddl-1.0", "common development", r"(?:the )?common development and distribution licen[cs]e", None),
    ("artistic-2.0", "artistic", r"(?:the )?artistic licen[cs]e(?:,? (?:version )?[12]\.0)?", r"opensource\.org/licenses/artistic-2\.0"),
    ("zlib", "zlib", r"(?:the )?zlib(?:/libpng)?", r"zlib\.net/zlib_license"),
    ("bsl-1.0", "boost", r"(?:the )?boost software licen[cs]e(?:,? (?:version )?1\.0)?", r"boost\.org/license_1_0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl", r"wtfpl\.net"),
    ("postgresql", "postgresql", r"(?:the )?postgresql", None),
    ("psf-2.0", "python software", r"(?:the )?python software foundation", None),
    ("php-3.01", "php", r"(?:the )?php licen[cs]e,? (?:version |v)?3\.01?", r"php\.net/license"),
    ("ofl-1.1", "sil open font", r"(?:the )?sil open font licen[cs]e(?:,? (?:version )?1\.1)?", r"scripts\.sil\.org/ofl"),
    ("eupl-1.2", "eupl", r"(?:the )?eupl(?:[- ]?(?:v\.? ?)?1\.[12])?", None),
    ("ms-pl", "microsoft public", r"(?:the )?microsoft public licen[cs]e", None),
    ("gfdl-1.3", "free documentation", r"(?:the )?gnu free documentation licen[cs]e(?:,? version 1\.[1-3])?", r"gnu\.org/(?:copyleft|licenses)/fdl"),
    ("odbl-1.0", "open database", r"(?:the )?open database licen[cs]e", r"opendatacommons\.org/licenses/odbl"),
    ("cc0-1.0", "cc0", r"cc0(?:[- ]1\.0)?", r"creativecommons\.org/publicdomain/zero"),
)
# Creative Commons: every set of terms in every version.
_TERMS = {"by": "attribution", "by-sa": "attribution[- ]share ?alike", "by-nc": "attribution[- ]non-?commercial",
          "by-nd": "attribution[- ]no ?deriv(?:ative)?s", "by-nc-sa": "attribution[- ]non-?commercial[- ]share ?alike",
          "by-nc-nd": "attribution[- ]non-?commercial[- ]no ?deriv(?:ative)?s"}
_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Forms of speech around a name, with their priority.
_FORMS = (
    (80, r"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[cs]e)?"),
    (75, r"(?:released|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of (?:the )?)?(?:{name})(?: licen[cs]e)?"),
    (60, r"(?:{name}) licen[cs]e(?:d)?"),
    (70, r"licen[cs]e ?[:=] ?[\"']?(?:{name})"),
)
_NOTICES = (
    ("mit", 85, "permission is hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("isc", 85, "permission to use", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee"),
    ("bsd", 85, "redistribution and use", r"redistribution and use in source and binary forms"),
    ("gpl", 85, "redistribute it", r"you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", 65, "at your option", r"either version \d(?:\.\d)? of the licen[cs]e,? or \(?at your option\)? any later version"),
    ("apache-2.0", 85, "in compliance with", r"you may not use this file except in compliance with the licen[cs]e"),
    ("public-domain", 70, "public domain", r"(?:released|dedicated|placed) (?:in)?to the public domain"),
    ("proprietary", 60, "all rights reserved", r"all rights reserved"),
    ("proprietary", 70, "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 75, "without permission", r"(?:may not|must not) be (?:copied|reproduced|distributed)[^.]{0,60} without (?:the )?(?:prior )?(?:written )?permission"),
    ("copyright", 30, "copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d"),
    ("copyright", 30, "©", r"© ?(?:19|20)\d\d"),
)


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern


def _gapped(pattern: str) -> str:
    """The pattern with gaps for its spaces; those in sets of two characters become an alternative."""
    return re.sub(r"\[([-/]) \]", r"(?:\1| )", pattern).replace(" ", _SPACE)


@lru_cache(maxsize=None)
def _keyword(keyword: str) -> re.Pattern:
    return re.compile(_gapped(re.escape(keyword).replace("\\ ", " ")))


def _holds(text: str, keyword: str) -> bool:
    words = keyword.split(" ")
    if not all(word in text for word in words):
        return False
    return len(words) == 1 or keyword in text or _keyword(keyword).search(text) is not None


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    found = []
    add = lambda label, priority, keyword, pattern: found.append(
        Rule(label, priority, keyword, re.compile(rf"(?<!{_WORD}){_gapped(pattern)}(?!{_WORD})"))
    )
    for label, keyword, name, url in LICENSES:
        add(label, 100, "spdx", rf"spdx-licen[cs]e-identifier: ?{re.escape(label)}(?:-only|-or-later)?")
        for priority, form in _FORMS:
            add(label, priority, keyword, form.format(name=name))
        if "licen" in name:
            # Such a name is a notice by itself.
            add(label, 55, keyword, f"(?:{name})")
        if url:
            add(label, 90, url.replace("\\", "").split("/")[0], rf"https?://(?:www\.)?{url}(?:\.(?:html|txt|php))?")
    for term, words in _TERMS.items():
        for version in _VERSIONS:
            label, number = f"cc-{term}-{version}", re.escape(version)
            add(label, 100, "spdx", rf"spdx-licen[cs]e-identifier: ?{label}")
            add(label, 85, "cc", rf"(?:licen[cs]ed under (?:a )?)?cc[- ]{term.replace('-', '[- ]')}[- ]{number}")
            add(label, 85, "creative commons", rf"creative commons {words} {number}(?: [a-z]+)? licen[cs]e")
            add(label, 90, "creativecommons", rf"https?://creativecommons\.org/licenses/{term}/{number}/?")
    for label, priority, keyword, pattern in _NOTICES:
        add(label, priority, keyword, pattern)
    return tuple(sorted(found, key=lambda rule: -rule.priority))


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    priority: int


def detections(text: str) -> list[Detection]:
    """Detections in a text whose A-Z are in lower case, after suppression, by place."""
    live: dict[str, bool] = {}
    found: list[Detection] = []
    for rule in rules():
        if rule.keyword not in live:
            live[rule.keyword] = _holds(text, rule.keyword)
        if live[rule.keyword]:
            found += [Detection(*hit.span(), rule.label, rule.priority) for hit in rule.pattern.finditer(text)]
    # By priority and length, so that what may contain another comes before it.
    found.sort(key=lambda x: (-x.priority, x.start - x.end, x.start, x.label))
    kept: list[Detection] = []
    starts, ends = [], []
    for one in found:
        inside = kept and np.any((np.array(starts) <= one.start) & (np.array(ends) >= one.end))
        if not inside:
            kept.append(one)
            starts.append(one.start)
            ends.append(one.end)
    return sorted(kept)


_KIND = np.zeros(256, bool)
_KIND[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BASE = {label: re.compile(rf"(?<!{_WORD})" + phrase.replace(" ", _GAP) + rf"(?!{_WORD})") for label, phrase in PHRASES.items()}
_LOWER = {upper: upper + 32 for upper in range(65, 91)}


def scan(text: str | None) -> dict[str, object]:
    """All result columns of one text but its id."""
    text = (text or "").translate(_LOWER) if not (text or "").isascii() else (text or "").lower()
    data = text.encode()
    inside = np.zeros(len(data) + 1, np.int8)
    inside[1:] = _KIND[np.frombuffer(data, np.uint8)]
    begins = np.flatnonzero(np.diff(inside) == 1)
    places, labels = [], set()
    if "license" in text:
        for label, pattern in _BASE.items():
            for hit in pattern.finditer(text):
                at = len(text[: hit.start()].encode())
                places.append(int(np.searchsorted(begins, at)))
                labels.add(label)
    found = detections(text)
    best = {label: 0.5 for label in labels}
    for one in found:
        best[one.label] = max(best.get(one.label, 0), one.priority / 100)
    rest = 1.0
    for label in sorted(best):
        rest *= 1 - best[label]
    return {
        "n_words": len(begins),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(best)),
        "score": 1 - rest,
        "spans": [{"start": one.start, "end": one.end, "label": one.label, "priority": one.priority} for one in found],
    }


def license_scan(docs: DataFrame) -> DataFrame:
    """The contract's columns and ``spans`` (code points) per row of ``docs`` (``doc_id, text``).

    Null and empty texts have no words and no labels. Rows that repeat are scanned one by one; of equal
    detections one stays. Empty input gives no rows. Other columns are left behind.
    """

    def step(batch: pa.RecordBatch):
        rows = list(map(scan, batch.column("text").to_pylist()))
        yield {"doc_id": batch.column("doc_id")} | {name: [row[name] for row in rows] for name in names}

    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans array<struct<start: long, end: long, label: string, priority: long>>"
    )
    return map_rows(docs.select("doc_id", "text"), schema, step)
