"""Registered queries over tables that have what the given ones lack."""

import duckdb

from quernstone.plans.catalogue import QUERIES, SQL


def test_incomplete_records_of_blank_texts(spark, tmp_path):
    """The fields that are looked at are those of the labels; a text that is blank or null is no missing field."""
    spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "  "), (5, "b"), (6, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, None), (4, 0, 1), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(SQL["incomplete_records"]).fetchall())
    assert want == [(3, "seen"), (4, "quality"), (5, "quality"), (6, "quality|seen")]
    assert sorted(map(tuple, QUERIES["incomplete_records"](spark, str(tmp_path)).collect())) == want
