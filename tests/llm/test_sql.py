import duckdb
import pytest

from thalassa.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = registry.queries()[name](spark, DIR)
    want = con.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, DIR).collect()
    assert 0 < len(rows) <= spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_mix_has_texts(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = corpus_pipeline.mix(spark, docs, DIR)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = out.collect()
    assert len(rows) == len(texts) and all(r.text == texts[r.doc_id] for r in rows)
