"""Queries that once left out a part of their table."""

from moltabula.operators import rowfn
from moltabula.plans.table_queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_map_rows_covers_every_document(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "n_chars").collect()
    want = sorted((d.doc_id, i) for d in docs if d.n_chars is not None and d.n_chars >= 100 for i in range(d.n_chars // 2000))
    assert any(i % 7 == 0 for i, _ in want)
    assert sorted(map(tuple, QUERIES["udf_map_rows"](spark, FOLDER).collect())) == want


def test_map_rows_drops_only_the_rows_that_fail_on_null(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i) for i in range(50)], "i long, n long")
    got = rowfn.map_rows(df, lambda r: {"i": r["i"], "twice": 2 * r["n"]}, "i long, twice long").collect()
    assert sorted(map(tuple, got)) == [(i, 2 * i) for i in range(50) if i % 7]
