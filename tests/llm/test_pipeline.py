"""The pipeline's stages on the smallest tables, and the queries that SQL expresses."""

import os

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, FOLDER)
        assert after.columns == columns
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
        assert set(ids(after)) <= set(ids(before)) and len(set(ids(after))) == len(ids(after))
        assert after.count() > 0.6 * before.count()
        if name == "line_dedup":
            assert ids(after) == ids(before)
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(ids(before))


@pytest.mark.parametrize("name", ["op3_url_rules", "op5_decontaminate", "op6_near_dup", "op7_quality_rules", "op9_substrings", "op10_line_dedup"])
def test_sql(spark, name):
    from docmill.llm import queries

    assert name in queries.ORACLE_SQL
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    a, b = queries.QUERIES[name](spark, FOLDER).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    shown = lambda df: sorted(tuple(map(repr, r)) for r in df[sorted(a.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None))
    assert shown(a) == shown(b)
