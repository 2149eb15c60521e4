"""Registered queries with SQL agree with DuckDB on the small tables; the pipeline runs through."""

import compare
import pytest

from plumbline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert compare.spark_rows(queries.QUERIES[name](spark, compare.SF)) == compare.oracle(queries.ORACLE_SQL[name])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    assert kept and kept <= {r.doc_id for r in docs.select("doc_id").collect()}
