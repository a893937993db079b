"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline
from voxelry.llm import decontamination, mixing

from .test_operators import SF, brute_classes, brute_lines, check_mix, plain, repeated_ids


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["identify_language", "dedup_lines", "join_near_duplicates", "decontaminate", "mix_sources"]
    junk = spark.createDataFrame([(99_001, "1234 !!", None, "src0", 7), (99_002, None, None, None, None)], docs.schema)
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language_id"](spark, docs.unionByName(junk), SF)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect()}
    two = stage["line_dedup"](spark, one, SF)
    assert two.columns == docs.columns and two.count() == one.count()
    assert two.where("length(text) <> n_chars").count() == one.where("length(text) <> n_chars").count()
    three = stage["ngram_join"](spark, two, SF)
    assert sorted(r.doc_id for r in three.collect()) == sorted(i for i, c, _ in brute_classes(plain(two)) if i == c)
    four = stage["decontamination"](spark, three, SF)
    bad = {r.doc_id for r in decontamination.decontamination(three, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.contaminated}
    assert {r.doc_id for r in three.collect()} - {r.doc_id for r in four.collect()} == bad and four.columns == docs.columns
    check_mix(four, stage["mixing"](spark, four, SF).collect())


def test_run_and_empty_table(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == mixing.mix(spark.read.parquet(f"{SF}/documents.parquet").limit(0)).columns and out.count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_repeated_ids(spark):
    """Rows that share an id with another text lose nothing by it."""
    docs = repeated_ids(spark)
    stage = dict(corpus_pipeline.STAGES)
    two = stage["line_dedup"](spark, stage["language_id"](spark, docs, SF), SF)
    assert Counter(plain(two)) == brute_lines(plain(docs)) and any("precious" in t for _, t in plain(two))
    three = plain(stage["ngram_join"](spark, two, SF))
    assert any("precious" in t for _, t in three) and {t for _, t in three} <= {t for _, t in plain(two)}
    assert all(n == 0 for _, _, n in brute_classes(three))  # no two of those kept are near
    assert stage["decontamination"](spark, stage["ngram_join"](spark, two, SF), SF).count() == len(three)
