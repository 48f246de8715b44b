"""Every llm query on the small tables, against SQL or its stated columns, and the pipeline stage by stage."""

from pathlib import Path

import duckdb
import pytest
from conftest_llm import ODD

import corpus_pipeline
from worklens.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = QUERIES[name](spark, str(DATA))
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: [(x is None, x) for x in r])
    assert order(got.select(columns).collect()) == order(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op3_benchmark_decontamination", "op5_best_fit_packing", "op6_chunk_dedup", "op11_prefix_trie", "op13_vector_codes"}))
def test_one_row_per_document(spark, name):
    ids = [r["doc_id"] for r in QUERIES[name](spark, str(DATA)).collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())


def test_pipeline_keeps_its_promises(spark):
    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = stage(spark, docs, str(DATA)).persist()
        assert docs.columns == columns
        assert {r["doc_id"] for r in docs.collect()} <= before
    packed = corpus_pipeline.packing(spark, docs, str(DATA)).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_stages_on_odd_rows(spark, docs):
    made = docs([*ODD])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, made, str(DATA)).persist()
    ids = [r["doc_id"] for r in made.collect()]
    assert ids.count(None) == 2 and ids.count(7) == 1 and ids.count(8) == 1
    assert {1, 3, 9, 10} <= set(ids) and not {2, 4, 5} & set(ids)
    assert {r["doc_id"] for r in corpus_pipeline.packing(spark, made, str(DATA)).collect()} == set(ids)


def test_stages_on_no_rows(spark, docs):
    made = docs([])
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, made, str(DATA))
    assert made.collect() == []
