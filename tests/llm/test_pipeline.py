"""The corpus pipeline, stage by stage, at a small scale."""

import corpus_pipeline
from turfline.llm.store import stored
from turfline.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = read_table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        if name in ("quality", "near_dedup"):
            assert 0 < docs.count() < before
            before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.where("start = 0").count() == docs.count()
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_stages_on_an_empty_table(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
