"""The stages on edge cases and on the smallest tables."""

import pytest
from llm_data import DATA, edges, empty  # noqa: F401

import corpus_pipeline


@pytest.mark.parametrize("where", ["edges", "empty", "data"])
def test_stages(where, spark, edges, empty, tmp_path):
    folder = {"edges": edges, "empty": empty, "data": DATA}[where]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.dtypes == columns
        if name in ("quality_rules", "ngram_jaccard_join"):
            assert docs.count() <= before
        if name == "substring_dedup":
            assert docs.count() == before
    assert docs.filter("not decoded").count() == 0
    assert (docs.count() > 0) == (where != "empty")
    if where == "data":
        assert corpus_pipeline.run(spark, folder).count() == docs.count()
