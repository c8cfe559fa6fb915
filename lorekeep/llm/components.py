"""Connected components of a graph given as edges, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorekeep.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``v, label`` for every vertex of ``edges`` (``a, b``); ``label`` is the smallest vertex of its component.

    No edges give no rows.

    Each pass takes the smallest label among the neighbours, as an aggregate with partial sums, so a vertex
    with very many edges gathers nothing; then it follows labels twice as far. Passes are
    checkpointed; one flag per pass reaches the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both)
    if both.isEmpty():
        return both.select(F.col("a").alias("v"), F.col("b").alias("label"))
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    labels = materialise(labels)
    while True:
        heard = (
            both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("_v")).agg(F.min("label").alias("_heard"))
        )
        step = labels.join(heard, F.col("v") == F.col("_v")).select(
            "v", "label", F.least("label", "_heard").alias("_next")
        )
        far = labels.select(F.col("v").alias("_u"), F.col("label").alias("_far"))
        step = step.join(far, F.col("_next") == F.col("_u")).select("v", F.col("label").alias("_old"), F.least("_next", "_far").alias("label"))
        step = materialise(step)
        if step.filter(F.col("_old") != F.col("label")).isEmpty():
            return step.select("v", "label")
        labels = step.select("v", "label")


def roots(leaders: DataFrame) -> DataFrame:
    """``v, label`` for every vertex that has a leader (``v, leader``, one row each, the leader smaller).

    ``label`` is the last of the chain of leaders; chains are followed twice as far in each pass. Passes are
    checkpointed; one flag per pass reaches the driver.
    """
    labels = materialise(leaders.select("v", F.col("leader").alias("label")))
    while True:
        far = labels.select(F.col("v").alias("_v"), F.col("label").alias("_far"))
        step = labels.join(far, F.col("label") == F.col("_v"), "left").select(
            "v", F.coalesce("_far", "label").alias("label"), F.col("_far").isNotNull().alias("_moved")
        )
        step = materialise(step)
        if step.filter("_moved").isEmpty():
            return step.select("v", "label")
        labels = step.select("v", "label")
