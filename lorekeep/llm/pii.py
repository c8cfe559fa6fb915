"""Personal data by patterns and by bootstrapped contexts, with DataFrame functions only.

Base entities are found by fixed patterns and checked. They are the seeds: the words before a seed are a
lexical pattern of its kind. Patterns and the identifiers that stand behind them form a graph, built
from distinct edges; in turns a pattern is scored by the part of its identifiers that are known to be of the
kind, and an unseen identifier by the patterns it stands behind (noisy-or). Patterns with enough seeds
and high confidence then mark identifiers that no base pattern covers.

Positions count code points. A text is cut by a pattern into matches and the pieces between
them; running sums of their lengths give the places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorekeep.llm.common import broadcast_if_small, hidden, row_key, shown
from lorekeep.session import materialise

KINDS = ("email", "ip", "card", "phone")
# Of the contract, written so that runs are neither entered in the middle nor given back: the same matches in
# linear time and without deep recursion.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Texts without these hold no match and are not searched.
_HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
# The form that an identifier found by its context must have, by kind.
_SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^[0-9]+(?:\.[0-9]+){2,}$",
    "card": r"^(?:[0-9]-?){12,19}$",
    "phone": r"^\+?[0-9][0-9.()-]{5,}$",
}
MIN_SEEDS = 5
CONFIDENT = 0.8
ROUNDS = 3
# Characters before an entity in which its context words are looked for.
_REACH = 64


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """Whether the digits pass the Luhn test."""
    backwards = F.reverse(_digits(text))

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(backwards, at, F.lit(1)).cast("int")
        twice = digit * 2
        doubled = F.when(twice > 9, twice - 9).otherwise(twice)
        return total + F.when(at % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda part: F.regexp_replace(part, "^0+", ""))
        return F.forall(parts, lambda part: (F.length(part) < 3) | ((F.length(part) == 3) & (part <= "255")))
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _matches(docs: DataFrame, kind: str, pattern: str, hint: str) -> DataFrame:
    """``key, kind, start, end, match, before``: every match, ``before`` the text shortly before it."""
    rows = docs.filter(F.col("text").rlike(hint)).select(
        "key",
        F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("_found"),
        F.split("text", pattern, -1).alias("_gaps"),
    )
    zipped = F.transform(
        "_found",
        lambda match, at: F.struct(
            match.alias("match"),
            F.char_length(F.element_at("_gaps", at + 1)).alias("gap"),
            F.right(F.element_at("_gaps", at + 1), F.lit(_REACH)).alias("before"),
        ),
    )
    rows = rows.filter(F.size("_found") > 0).select("key", F.posexplode(zipped).alias("at", "_match"))
    rows = rows.select("key", "at", "_match.*")
    # Rows that repeat share a key and have the same matches.
    rows = rows.groupBy("key", "at").agg(*[F.first(name).alias(name) for name in ("match", "gap", "before")])
    upto = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("match")).over(upto)
    return rows.select(
        "key", F.lit(kind).alias("kind"), (end - F.char_length("match")).alias("start"), end.alias("end"), "match", "before"
    )


def base_spans(docs: DataFrame) -> DataFrame:
    """Checked matches of the four kinds in ``docs`` (``key, text``)."""
    kinds = [
        _matches(docs, kind, PATTERNS[kind], _HINTS[kind]).filter(_valid(kind, F.col("match"))) for kind in KINDS
    ]
    return reduce(DataFrame.unionByName, kinds)


def _patterns(before: Column) -> Column:
    """The last word before, and the last two, in lower case; none without a word."""
    words = F.filter(F.split(F.lower(before), r"[\x20\x09-\x0D]+"), lambda word: word != "")
    n = F.size(words)
    one = F.when(n > 0, F.element_at(words, -1))
    two = F.when(n > 1, F.concat_ws(" ", F.element_at(words, -2), F.element_at(words, -1)))
    return F.filter(F.array(one, two), lambda pattern: pattern.isNotNull())


def _unseen(docs: DataFrame, base: DataFrame) -> DataFrame:
    """Candidate identifiers that touch no base span."""
    words = r"[A-Za-z0-9+._%@-]*[0-9@][A-Za-z0-9+._%@-]*"
    pattern = rf"(?<![A-Za-z0-9+._%@-]){words}"
    found = _matches(docs, "", pattern, "[0-9@]")
    # Marks at the end of a sentence are no part of an identifier.
    bare = F.regexp_replace("match", r"[.,%-]+$", "")
    found = found.withColumn("end", F.col("start") + F.char_length(bare)).withColumn("match", bare)
    found = found.filter(F.char_length("match") >= 6)
    both = found.withColumn("base", F.lit(False)).unionByName(base.withColumn("base", F.lit(True)))
    order = Window.partitionBy("key").orderBy("start", F.col("base").desc())
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (following.isNull() | (following >= F.col("end")))
    return both.withColumn("_clear", clear).filter("not base and _clear").drop("base", "_clear")


def _shaped() -> Column:
    """The kinds that a candidate's form allows."""
    kinds = [F.when(F.col("match").rlike(shape), F.lit(kind)) for kind, shape in _SHAPES.items()]
    return F.filter(F.array(*kinds), lambda kind: kind.isNotNull())


def learned(base: DataFrame, unseen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, kind, score``: the patterns that are trusted.

    The graph has one edge per pattern, identifier and kind it may be of; seeds count as 1. A pattern
    needs ``MIN_SEEDS`` distinct seeds of the kind.
    """
    known = base.select(F.explode(_patterns(F.col("before"))).alias("pattern"), "kind", "match", F.lit(1.0).alias("seed"))
    maybe = unseen.select(
        F.explode(_patterns(F.col("before"))).alias("pattern"), F.explode_outer(_shaped()).alias("kind"), "match",
        F.lit(0.0).alias("seed"),
    )
    edges = known.unionByName(maybe).groupBy("pattern", "kind", "match").agg(F.max("seed").alias("seed"))
    # All identifiers behind a pattern count against it, whatever their kind.
    reach = edges.groupBy("pattern").agg(F.countDistinct("match").alias("behind"))
    seeds = edges.filter("seed = 1").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    strong = seeds.filter(F.col("seeds") >= MIN_SEEDS).join(reach, "pattern")
    graph = materialise(edges.join(strong, ["pattern", "kind"]).select("pattern", "kind", "match", "seed", "behind"))
    belief = F.col("seed")
    scores = None
    for _ in range(rounds):
        rows = graph if scores is None else graph.join(
            graph.join(scores, ["pattern", "kind"])
            .groupBy("kind", "match")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))).alias("heard")),
            ["kind", "match"],
        )
        if scores is not None:
            # What only trusted patterns vouch for counts as far as they do.
            belief = F.greatest(F.col("seed"), F.when(F.col("heard") >= CONFIDENT, F.col("heard")).otherwise(0.0))
        scores = materialise(
            rows.groupBy("pattern", "kind").agg((F.sum(belief) / F.first("behind")).alias("score"))
        )
        if scores.isEmpty():
            break
    return scores.filter(F.col("score") >= CONFIDENT)


def spans(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``key, kind, start, end, base`` over ``docs`` (``doc_id, text``); ``key`` is ``row_key`` of the document."""
    rows = docs.select(row_key("doc_id", "text").alias("key"), "text")
    base = materialise(base_spans(rows))
    unseen = materialise(_unseen(rows, base))
    patterns = learned(base, unseen, rounds)
    found = base.select("key", "kind", "start", "end", F.lit(True).alias("base"))
    if patterns.isEmpty():
        return found
    behind = unseen.select(
        "key", "start", "end", F.explode(_patterns(F.col("before"))).alias("pattern"), F.explode(_shaped()).alias("kind")
    )
    more = behind.join(broadcast_if_small(patterns), ["pattern", "kind"]).select(
        "key", "kind", "start", "end", F.lit(False).alias("base")
    )
    return found.unionByName(more.distinct())


def _listed(rows: Column) -> Column:
    ordered = F.array_sort(rows)
    kind = lambda span: F.element_at(F.array(*map(F.lit, KINDS)), span["rank"])
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")


def report(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``) the contract's counts, digest and list of spans.

    Null and empty texts have none. Rows that repeat get the same result. Empty input gives no rows.
    Other columns are left behind.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct(F.col("start"), rank.alias("rank"), F.col("end"))
    by_doc = spans(docs, rounds).groupBy("key").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == kind)).alias(f"n_{kind}") for kind in KINDS],
        F.collect_list(F.when(F.col("base"), span)).alias("_base"),
        F.collect_list(span).alias("_all"),
    )
    by_doc = by_doc.withColumnRenamed("key", "_key")
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("key"))
    joined = rows.join(by_doc, F.col("key").eqNullSafe(F.col("_key")), "left")
    text = lambda name: F.coalesce(_listed(F.col(name)), F.lit(""))
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(text("_base"), 256).alias("base_sha256"),
        text("_all").alias("spans"),
    )


def redacted(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``n_chars``, if there, follows the text."""
    span = F.struct("start", "end", F.upper("kind").alias("kind"))
    by_doc = materialise(spans(docs, rounds).groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("_spans")))
    rows, names = hidden(docs)
    own = F.col(names["text"])
    same = row_key(names["doc_id"], names["text"]).eqNullSafe(F.col("key"))
    rows = rows.join(broadcast_if_small(by_doc, 10_000), same, "left")
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("end"))

    def put(done: Column, span: Column) -> Column:
        # A span that begins inside the one before only lengthens it.
        between = own.substr((done["end"] + 1).cast("int"), (span["start"] - done["end"]).cast("int"))
        fresh = F.concat(done["text"], between, F.lit("<"), span["kind"], F.lit(">"))
        return F.struct(
            F.when(span["start"] >= done["end"], fresh).otherwise(done["text"]).alias("text"),
            F.greatest(done["end"], span["end"]).alias("end"),
        )

    rest = lambda done: own.substr((done["end"] + 1).cast("int"), F.char_length(own))
    whole = F.aggregate("_spans", start, put, lambda done: F.concat(done["text"], rest(done)))
    rows = rows.withColumn("_redacted", F.when(F.col("_spans").isNull(), own).otherwise(whole))
    if "n_chars" in names:
        count = F.when(F.col("_spans").isNull(), F.col(names["n_chars"])).otherwise(F.char_length("_redacted"))
        rows = rows.withColumn("_counted", count)
        names = names | {"n_chars": "_counted"}
    return shown(rows, names | {"text": "_redacted"})
