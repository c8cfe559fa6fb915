"""Quality rules on the level of hosts.

Every document is measured on its whole text. A document fails if a rule of its own is broken; the
failures are summed up by host (the ``source`` of a document), the rates shrunk by an empirical beta
prior, so that a host with few documents is judged by what is usual, and the verdict on the host goes
back to its documents: on a bad host, documents that break a softer rule are rejected too. A
document that breaks no rule is kept wherever it stands.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorekeep.llm.common import broadcast_if_small, hidden, map_rows, shown
from lorekeep.session import materialise

MIN_WORDS = 50
REPEATED_PERCENT = 50
# Softer rules: percent of symbols among the characters of words, of repeated lines among lines with a word,
# of words in repeated windows.
SOFT_SYMBOLS, SOFT_LINES, SOFT_REPEATED = 10, 30, 20
# A host is bad above this shrunk failure rate.
BAD_RATE = 0.5
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, words in repeated 3-word windows, lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, covered = Counter(windows), -1
        for at, window in enumerate(windows):
            if counts[window] > 1:
                # Positions at..at+2, of which those up to ``covered`` are counted already.
                repeated += at + 2 - max(covered, at - 1)
                covered = at + 2
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures, in one pass; columns with their names are replaced."""
    names = [part.split()[0] for part in MEASURES.split(", ")]
    rows = docs.drop(*names)
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema) + ", " + MEASURES

    def step(batch: pa.RecordBatch):
        found = [measure(value) for value in batch.column(text).to_pylist()]
        columns = {name: batch.column(name) for name in batch.schema.names}
        yield columns | {name: [row[at] for row in found] for at, name in enumerate(names)}

    return map_rows(rows, schema, step)


def flagged(rows: DataFrame) -> DataFrame:
    """With ``base_failed`` (the document's own verdict) and ``soft_failed`` (counts on bad hosts)."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    soft = (
        (100 * F.col("n_symbols") > SOFT_SYMBOLS * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > SOFT_LINES * F.col("n_lines"))
        | (100 * F.col("n_repeat_words") > SOFT_REPEATED * F.col("n_words"))
    )
    return rows.withColumns({"base_failed": base, "soft_failed": soft})


def host_verdicts(rows: DataFrame, host: str = "source", bad_rate: float = BAD_RATE) -> DataFrame:
    """``_host, host_docs, host_failures, host_rate, host_bad`` per host.

    Beta prior by moments over the hosts' rates; where these do not vary, or vary more than a beta
    can, the prior is worth one document at the mean rate. One summary row leaves the executors.
    """
    failed = (F.col("base_failed") | F.col("soft_failed")).cast("long")
    hosts = rows.groupBy(F.coalesce(host, F.lit("")).alias("_host"), F.col(host).isNull().alias("_none")).agg(
        F.count("*").alias("host_docs"), F.sum(failed).alias("host_failures")
    )
    # Read three times: for the prior, for its size, for the join.
    hosts = materialise(hosts)
    rate = F.col("host_failures") / F.col("host_docs")
    mean, spread = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    mean, spread = mean or 0.0, spread or 0.0
    strength = mean * (1 - mean) / spread - 1 if 0 < spread < mean * (1 - mean) else 1.0
    shrunk = (F.col("host_failures") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_bad", F.col("host_rate") > bad_rate)


def judged(rows: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """Measured rows with ``host_rate, host_bad, kept``."""
    sides = broadcast_if_small(hosts.select("_host", "_none", "host_rate", "host_bad"))
    same = (F.coalesce(F.col(host), F.lit("")) == F.col("_host")) & (F.col(host).isNull() == F.col("_none"))
    joined = rows.drop("host_rate", "host_bad").join(sides, same).drop("_host", "_none")
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_bad") & F.col("soft_failed")))


def quality_rules(docs: DataFrame, bad_rate: float = BAD_RATE) -> DataFrame:
    """Measures, verdicts and ``kept`` per row of ``docs`` (``doc_id, source, text``), without the text.

    A null or empty text has no words and fails; a null source is a host like others. Rows that
    repeat are judged one by one. Empty input gives no rows. Other columns are left behind.
    """
    # The narrow measures are used for the hosts and for the verdict: measured once.
    rows = materialise(flagged(measured(docs.select("doc_id", "source", "text"))).drop("text"))
    return judged(rows, host_verdicts(rows, bad_rate=bad_rate))


def keep_good(docs: DataFrame, bad_rate: float = BAD_RATE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    Texts are measured twice, which costs less than moving them to meet the verdicts.
    """
    hosts = host_verdicts(flagged(measured(docs.select("source", "text"))), bad_rate=bad_rate)
    rows, names = hidden(docs)
    rows = judged(flagged(measured(rows, names["text"])), hosts, names["source"])
    return shown(rows.filter("kept"), names)
