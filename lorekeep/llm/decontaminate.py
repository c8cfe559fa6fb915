"""Benchmark decontamination with DataFrame functions only.

The test items give windows of ten words (an item with fewer gives one window of all its words).
A window of ``m`` words is bound to hold a run of ``g = (m + 1) // 2`` words that starts at a multiple of ``g`` in
the document, so a document is scanned by every ``g``-th run only. All runs of all windows form a hash
set that is broadcast, if it is as small as benchmarks are, and shuffled otherwise. A run that is in
the set carries the words around it, on which the whole window is verified word by word.

A document is cut into runs by one regular expression, after its marks have become single spaces: no array of its
words is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lorekeep.llm.common import LETTERS, ascii_lower, broadcast_if_small, hidden, row_key, shown
from lorekeep.session import materialise

WINDOW = 10
# Runs of test windows that may be broadcast: about 250 bytes each.
BROADCAST_RUNS = 200_000
# What stands between words, a character each: Java looks a class without ranges up in a table, one with ranges range by range.
MARKS = "".join(f"\\x{code:02X}" for code in range(128) if not chr(code).isalnum())
# The same words before A-Z are lowered; lowering only what is compared spares a pass over the text.
MIXED = f"[^{MARKS}]+"


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(MIXED), F.lit(0))


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``item_id`` (a string), ``m``, ``window`` (its words): every window of every item."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)).alias("_words"),
    ).filter(F.size("_words") > 0)
    rows = rows.withColumn("m", F.least(F.size("_words"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("_words") - F.col("m") + 1)
    windows = F.transform(starts, lambda at: F.slice("_words", at, F.col("m")))
    return rows.select("item_id", "m", F.explode(windows).alias("window")).distinct()


def _runs(windows: DataFrame) -> DataFrame:
    """``run`` (hash of its length and words), ``m``, ``shift`` (words of the window before it), ``window``, ``item_id``."""
    g = F.expr("(m + 1) div 2").cast("int")
    shifts = F.sequence(F.lit(0), F.col("m") - g)
    rows = windows.withColumn("shift", F.explode(shifts))
    run = F.lower(F.array_join(F.slice("window", F.col("shift") + 1, g), " "))
    return rows.select(F.xxhash64(g, run).alias("run"), "m", "shift", "window", "item_id")


def _cut(spaced: Column, g: int) -> Column:
    """The words of a text with single spaces, ``g`` to a string; what is left at the end makes a shorter one."""
    return F.regexp_extract_all(spaced, F.lit(f"[^ ]++(?: [^ ]++){{0,{g - 1}}}+"), F.lit(0))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``key, start, m, item_id``: the windows of items that occur in documents, words counted from 0.

    ``key`` is ``row_key`` of the document. Documents are scanned once and cut for each length of runs; all but one or two of the
    lengths come from items shorter than ``n`` words. What is left is a row per occurrence.
    """
    windows = materialise(item_windows(benchmark, n))
    lengths = windows.select(F.expr("(m + 1) div 2").cast("int").alias("g")).distinct().collect()  # at most n numbers
    if not lengths:
        empty = docs.select(row_key("doc_id", "text").alias("key")).limit(0)
        return empty.select("key", F.lit(0).alias("start"), F.lit(0).alias("m"), F.lit("").alias("item_id"))
    spaced = F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), f"[{MARKS}]+", " "))
    rows = docs.select(row_key("doc_id", "text").alias("key"), spaced.alias("_spaced"))
    cut = [F.struct(F.lit(g).alias("g"), _cut(F.col("_spaced"), g).alias("cut")) for g in sorted(row.g for row in lengths)]
    scanned = rows.select("key", F.inline(F.array(*cut))).select("key", "g", "cut", F.posexplode("cut").alias("at", "run"))
    # A window that holds the run begins in the run before at the earliest, and ends in the next one. Within one stage the words
    # around a run are only put together once it is met.
    around = F.array_join(F.slice("cut", F.greatest(F.col("at"), F.lit(1)), F.when(F.col("at") > 0, 3).otherwise(2)), " ")
    scanned = scanned.select(
        "key",
        (F.col("at") * F.col("g")).alias("at"),
        (F.greatest(F.col("at") - 1, F.lit(0)) * F.col("g")).alias("first"),
        F.xxhash64("g", F.lower("run")).alias("run"),
        around.alias("around"),
    )
    start = F.col("at") - F.col("shift")
    inside = F.slice(F.split("around", " "), F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("m"))
    runs = broadcast_if_small(_runs(windows), BROADCAST_RUNS)
    return (
        scanned.join(runs, "run")
        .filter((start >= 0) & (ascii_lower(F.array_join(inside, " ")) == F.array_join("window", " ")))
        .select("key", start.alias("start"), "m", "item_id")
    )


def _covered(spans: Column) -> Column:
    """How many words the spans ``(start, m)`` cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(seen: Column, span: Column) -> Column:
        end = span["start"] + span["m"]
        return F.struct(
            F.greatest(seen["end"], end).alias("end"),
            (seen["n"] + F.greatest(end - F.greatest(seen["end"], span["start"]), F.lit(0))).alias("n"),
        )

    return F.aggregate(F.array_sort(spans), start, add)["n"]


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words. Items without words never match; a null item id counts as the
    empty string. Rows of the same id and text get the same result, rows of one id and other texts their
    own. Empty tables give no rows, or rows without hits. Other columns are left behind.
    """
    by_doc = hits(docs, benchmark, n).groupBy("key").agg(
        F.collect_set(F.struct("start", "m")).alias("_spans"), F.collect_set("item_id").alias("_items")
    )
    by_doc = by_doc.select(
        F.col("key").alias("_key"),
        _covered(F.col("_spans")).alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
    )
    counted = docs.select(
        "doc_id", row_key("doc_id", "text").alias("key"), F.size(words()).cast("long").alias("n_words")
    )
    none = F.sha2(F.lit(""), 256)
    return counted.join(by_doc, F.col("key").eqNullSafe(F.col("_key")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WINDOW) -> DataFrame:
    """``docs`` without contamination, with all their columns.

    ``mode="documents"`` drops every row with a hit; ``mode="spans"`` cuts the hit words out of ``text``, each with
    the white space or marks behind it.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"no mode {mode!r}")
    found = hits(docs, benchmark, n)
    rows, names = hidden(docs)
    same = row_key(names["doc_id"], names["text"]).eqNullSafe(F.col("key"))
    if mode == "documents":
        dirty = materialise(found.select("key").distinct())
        return shown(rows.join(broadcast_if_small(dirty), same, "left_anti"), names)
    places = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("m") - 1))
    dirty = materialise(found.select("key", places.alias("at")).groupBy("key").agg(F.collect_set("at").alias("hit")))
    rows = rows.join(broadcast_if_small(dirty, 10_000), same, "left")
    gaps = F.split(names["text"], MIXED)
    kept = F.transform(
        words(names["text"]),
        lambda word, at: F.when(F.array_contains("hit", at), "").otherwise(F.concat(word, F.element_at(gaps, at + 2))),
    )
    cut = F.concat(F.element_at(gaps, 1), F.array_join(kept, ""))
    text = F.when(F.col("hit").isNull(), F.col(names["text"])).otherwise(cut)
    return shown(rows.withColumn(names["text"], text), names)
