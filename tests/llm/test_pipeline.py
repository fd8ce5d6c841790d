"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from codeshoal.llm import linededup, mixing, pieces, simhash, toxicity

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(
    not (os.path.isdir(SF_DIR) and os.path.exists(pieces.MODEL)), reason="no test data")


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
        if name == "line_dedup":
            assert sizes[-1] == sizes[-2]
            again = linededup.dedup_lines(docs)
            assert again.where("text <> ''").count() == docs.where("text <> ''").count()
        if name == "near_dedup":
            classes = simhash.simhash_classes(before)
            assert {r[0] for r in docs.select("doc_id").collect()} == {
                r[0] for r in classes.select("component_id").distinct().collect()}
        if name == "mixing":
            assert sizes[-1] == mixing.mix_plan(before).agg({"copies": "sum"}).first()[0]
    assert sizes[1] < sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert last.count() == sizes[-1]
    assert "toxicity" in corpus_pipeline.STAGES[0][0] and toxicity.SLOTS
    assert corpus_pipeline.run(spark, SF_DIR).columns == last.columns
