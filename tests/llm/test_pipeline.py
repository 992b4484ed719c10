"""The pipeline's stages on awkward rows, and the whole on a small table."""

import os

import pytest

import corpus_pipeline

from . import edge

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    edge.documents(spark).write.parquet(f"{out}/documents.parquet")
    edge.labels(spark).write.parquet(f"{out}/labels.parquet")
    edge.benchmark(spark).write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == "encoding" or out.columns == docs.columns
        assert stage(spark, edge.none(docs), folder).count() == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_decisions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert len({5, 6, 7} & {r.doc_id for r in kept.collect()}) == 1
    assert not {8, 10} & {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, folder).collect()}
    assert corpus_pipeline.run(spark, folder).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: sorted((r.doc_id, r.n_tokens) for r in df.collect())
    assert key(docs) == key(corpus_pipeline.run(spark, SF))
