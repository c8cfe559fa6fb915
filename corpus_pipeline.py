"""The pipeline over ``documents``: each stage works on what the one before kept."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import decontaminate, mixing, near_dedup, pii, quality
from lorekeep.session import scratch_path, ship

_ROOT = Path(__file__).resolve().parent


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship(spark, _ROOT / "lorekeep")
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    ship(spark, _ROOT / "lorekeep")
    return near_dedup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    ship(spark, _ROOT / "lorekeep")
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    ship(spark, _ROOT / "lorekeep")
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark, _ROOT / "lorekeep")
    return mixing.take(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontaminate_stage),
    ("personal data", redact_stage),
    ("mixing sources", mix_sources),
]

# Near copies are found by hashing with a fixed seed, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{place}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
