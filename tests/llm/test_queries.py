"""The registered queries against their DuckDB texts, and the pipeline stage by stage."""

import os

import pytest
from contract.compare import compare, duck
from tidewire.llm.queries import ORACLES, QUERIES
from tidewire.session import materialise

import corpus_pipeline

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")


def test_one_query_per_operator():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_duckdb(spark, name):
    assert compare(spark, duck(SF), name, SF, QUERIES[name], ORACLES[name]).startswith("ok")


@needs_data
def test_every_row_has_an_answer(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in sorted(set(QUERIES) - set(ORACLES) - {"op3_best_fit_packing"}):
        assert QUERIES[name](spark, SF).count() == rows, name


@needs_data
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), "stage")
        assert docs.columns == columns, name
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= kept and left
        kept = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept
    assert packed.where("length > 4096 or offset + length > 4096").count() == 0


def test_stages_survive_odd_rows(spark, docs, no_docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            frame = materialise(stage(spark, frame, str(tmp_path)), "odd")
        assert "sequence_id" in frame.columns
