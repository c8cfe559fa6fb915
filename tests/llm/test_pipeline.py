import pytest

import corpus_pipeline as C
from lorekeep.llm import decontaminate, near_dedup, quality


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    prose = lambda k: " ".join(f"w{at * k % 997}x{k}" for at in range(120))
    more = [(1000 + k, prose(k), "en", f"s{k % 3}", 5, None, None, None) for k in range(30)]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, prose(3)[:200]), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_every_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    one = C.quality_rules(spark, docs, folder)
    assert one.count() == quality.quality_rules(docs).filter("kept").count()
    two = C.near_dedup_stage(spark, one, folder)
    assert two.count() == near_dedup.near_duplicates(one).select("group_id").distinct().count()
    three = C.decontaminate_stage(spark, two, folder)
    assert three.count() == decontaminate.report(two, items).filter("not contaminated").count() == two.count() - 1
    four = C.redact_stage(spark, three, folder)
    assert all(frame.columns == docs.columns for frame in (one, two, three, four))
    assert four.count() == three.count()
    assert set(C.mix_sources(spark, four, folder).columns) >= set(docs.columns)


def test_run(spark, folder):
    assert [name for name, _ in C.STAGES] == ["quality rules", "near dedup", "decontamination", "personal data", "mixing sources"]
    assert C.run(spark, folder).count() > 10


@pytest.mark.parametrize("place", range(5))
def test_stages_without_rows(spark, folder, place):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert C.STAGES[place][1](spark, empty, folder).count() == 0
