"""The registered queries against their SQL on the smallest given data, and the pipeline."""

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from barworks.llm.queries import ORACLES, QUERIES
from barworks.session import materialize

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = sorted(repr([r[i] for i in at]) for r in rel.fetchall())
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == want


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns
        now = docs.count()
        assert now == before if name == "source_mix" else 0 < now <= before
        before = now
    assert corpus_pipeline.tokens(spark, docs, SF).count() == before
