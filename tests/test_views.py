"""Texts of the evidence view, which meet no join."""

import datetime as dt
from collections import Counter

import duckdb

from lodestar.plans import extra_queries, queries as q  # noqa: F401  the former registers its queries
from lodestar.sources import views

SF = "/root/testdata/sf0.001"


def test_texts_are_those_of_the_evidence(spark, tmp_path):
    """Ids that come several times in events, labels, both or documents, and none."""
    day = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "a" * 90), (2, "b"), (2, "c"), (3, None), (4, ""), (5, "e"), (None, "f")], "doc_id long, text string").selectExpr("*", "'web' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, day), (1, day), (2, day), (2, day), (2, day), (3, day), (9, day), (9, day), (None, day), (None, day)], "event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(2, 1), (2, 0), (4, 1), (4, 1), (5, 0), (None, 1), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got, want = views.texts(spark, str(tmp_path)), views.view(spark, str(tmp_path), "evidence").select("id", "title", "content")
    assert got.schema.simpleString() == want.schema.simpleString()
    rows = Counter(tuple(r) for r in got.collect())
    assert rows == Counter(tuple(r) for r in want.collect()) and rows[2, "b", "b"] == 6


def test_projection_shuffles_no_texts(spark):
    """Also where events are too many for a broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        plan = q.QUERIES["v8_projection"](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    finally:
        spark.conf.set(name, before)


def test_projection_is_of_whole_texts(spark, tmp_path):
    """Texts that differ behind their first thousand letters only."""
    own = [(i, "alpha beta gamma " * 60 + end) for i, end in enumerate(["", "delta epsilon " * 200, "zeta eta theta " * 400, "zeta eta theta " * 399])]
    spark.createDataFrame(own, "doc_id long, text string").selectExpr("*", "'web' AS source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, dt.datetime(2024, 1, 1))], "event_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(map(tuple, q.QUERIES["v8_projection"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    for t in ("documents", "events", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(c.execute(q.ORACLE_SQL["v8_projection"]).fetchall())
    assert got == want and len({r[1:] for r in got}) == 4
