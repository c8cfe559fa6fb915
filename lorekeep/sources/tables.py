"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """A Parquet table; with ``spread_by``, rows of a small scan are spread over all cores.

    A file is read by one task per row group. For work that costs far more than the scan, such as
    chunking and embedding, fewer scan tasks than cores would leave cores idle, so the rows are then
    shuffled by ``spread_by``, which has to be a key without hot values. A scan with enough tasks,
    as any large table has, is left as it is.
    """
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    # A scan alone: counting its partitions plans it and runs nothing.
    if spread_by is None or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores, spread_by)
