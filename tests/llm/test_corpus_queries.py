import pytest
from oracle import both, connect

import corpus_pipeline
from panelspark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, small, name):
    got, want = both(spark, small, QUERIES[name], ORACLES[name], connect(small))
    assert got == want


def test_pipeline_keeps_and_drops(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes, at = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, small)
        assert at.columns == docs.columns, name
        sizes.append(at.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.8 * sizes[0]
    packed = corpus_pipeline.run(spark, small)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
