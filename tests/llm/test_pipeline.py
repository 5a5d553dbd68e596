from __future__ import annotations

import os

import pytest

import __spark_entry__
import corpus_pipeline

from .conftest import EDGE, frame

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "bpe"]
    assert {f"op{n}_" for n in range(1, 11)} == {q.split("_")[0] + "_" for q in __spark_entry__.queries() if q.startswith("op")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        left = out.count()
        assert 0 < left <= n and (name == "bpe" or out.columns == columns)
        docs, n = out, left
    assert n >= 100


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of edge cases: nulls, empty and long texts, ties, repeated rows, clashing names."""
    path = str(tmp_path_factory.mktemp("edge"))
    frame(spark, EDGE).selectExpr("*", "1 AS _t", "2 AS _gone", "'mine' AS n_dropped").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (11, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "repeated often own line eleven"), (None, "x"), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_takes_edge_cases(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == "bpe":
            assert out.count() == docs.count()
            assert stage(spark, docs.where("false"), folder).count() == 0
            continue
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert out.where("_t = 1 AND _gone = 2 AND n_dropped = 'mine' AND n_lines = 'clash'").count() == out.count()
        empty = stage(spark, docs.where("false"), folder)
        assert empty.columns == docs.columns and empty.count() == 0


def test_run_is_its_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
    want = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in docs.collect())
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want and 1 < len(got) < len(EDGE)
