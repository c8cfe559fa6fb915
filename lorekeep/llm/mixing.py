"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. Documents of a source stand in
one order; the expected copies are summed up along it, one random offset per source is added, and
a document is taken once for each whole number that its stretch of the sum crosses. The order goes
by size, so the words taken differ from the target by little more than a large document.

The sum runs over blocks: a source is cut by size class and by a hash of the document, so that a
source with a third of all rows is spread over many tasks; only block totals meet per source.
Expected copies are whole multiples of 2**-28, so that sums are exact and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lorekeep.llm.common import WORD, hidden, shown

WEIGHTS = (5, 2, 1)
CAP = 3.0
SEED = 17
# Documents that one block of a source and size class holds, about.
BLOCK_ROWS = 20_000
_UNIT = 28


def sizes(text: str = "text") -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _hashed(seed: int, column: str) -> Column:
    """28 bits of a hash that every engine has."""
    name = F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("long")


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``.

    Weights go to the sources by code point, null last, and repeat. A target stops at ``cap`` times
    the source's size; what is left over goes to the others by weight, until none is above. Sources
    in ascending order of cap to weight are full up to some point; behind it all get the same
    ``level`` per weight. The windows hold one row per source, nothing per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
    )
    rows = totals.withColumn("weight", weight).withColumn("_cap", F.lit(cap) * F.col("source_size"))
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    line = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, everything = line.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    rows = (
        rows.withColumn("_place", F.row_number().over(line))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_mix_size", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_weights", F.sum("weight").over(everything))
    )
    rows = rows.withColumn("_level", (F.col("_mix_size") - F.col("_full")) / (F.col("_weights") - F.col("_gone")))
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_place", "_level"))).over(everything)
    rows = rows.withColumn("_first", first)
    target = F.when(F.col("_place") < F.col("_first._place"), F.col("_cap")).otherwise(
        F.col("weight") * F.col("_first._level")
    )
    return rows.select("source", "source_size", "weight", F.coalesce(target, F.col("_cap")).alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    cap: float = CAP,
    seed: int = SEED,
    id_column: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All rows of ``docs`` with ``size, source_size, target, copies, taken``.

    ``docs`` needs ``source`` and either ``size`` or ``text``. ``copies`` says how often the mix takes the
    row: at most ``cap`` rounded up. Nulls: a null source is a source, a null text or size has no words, a
    null id is an id like others. Rows that repeat are rows of their own, sampled one by one.
    Empty input gives no rows. Other columns are kept; columns with the names of the results
    (``source_size, target, copies, taken``) are replaced.
    """
    rows = docs.drop("source_size", "target", "copies", "taken")
    size = F.coalesce(F.col("size").cast("long"), F.lit(0)) if "size" in rows.columns else sizes()
    blocks = max(1, -(-docs.count() // block_rows))
    # Classes are a quarter of a power of two wide.
    rows = rows.withColumn("size", size).withColumns(
        {
            "_mix_class": F.floor(F.log2(F.col("size") + F.lit(1.0)) * 4).cast("int"),
            "_mix_part": _hashed(seed, id_column) % blocks,
            # A source as a key that is never null.
            "_mix_key": F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))),
        }
    )
    place = ["_mix_key", "_mix_class", "_mix_part"]
    parts = rows.groupBy(*place, "source").agg(F.sum("size").alias("_mix_size"), F.count("*").alias("_mix_rows"))
    goals = targets(parts.groupBy("source").agg(F.sum("_mix_size").alias("source_size")), weights, cap)
    unit = F.lit(float(1 << _UNIT))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("_mix_each", F.round(expected * unit).cast("long")).withColumn(
        "_mix_goal", F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    ).drop("source", "weight")
    along = Window.partitionBy("_mix_key").orderBy("_mix_class", "_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.withColumn("_mix_before", F.coalesce(F.sum("_mix_rows").over(along), F.lit(0)))
        .join(goals, F.col("_mix_key") == F.col("_mix_goal"))
        .select(*place, "source_size", "target", "_mix_each", "_mix_before")
    )
    joined = rows.join(starts, place)
    inside = Window.partitionBy(*place).orderBy("size", F.col(id_column).asc_nulls_last())
    offset = _hashed(seed + 1, "_mix_key")
    upto = (F.col("_mix_before") + F.row_number().over(inside)) * F.col("_mix_each") + offset
    crossed = F.shiftright(upto, _UNIT) - F.shiftright(upto - F.col("_mix_each"), _UNIT)
    taken = joined.withColumn("copies", crossed).withColumn("taken", F.col("copies") * F.col("size"))
    return taken.drop(*place, "_mix_each", "_mix_before")


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with ``copy`` counting from 1."""
    rows, names = hidden(docs)
    kept = [F.col(neutral) for neutral in names.values()]
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    sized = rows.select(*kept, F.col(names["doc_id"]).alias("doc_id"), F.col(names["source"]).alias("source"), sizes(names["text"]).alias("size"))
    taken = mix(sized, **options).filter("copies > 0").select(*kept, copies)
    names = {name: neutral for name, neutral in names.items() if name != "copy"}
    return shown(taken, names | {"copy": "copy"})
