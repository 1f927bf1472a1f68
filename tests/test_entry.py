"""The driver's contract."""

import __spark_entry__ as entry


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    df = entry.entry(spark)
    assert df.columns == ["query_id", "id", "rerank_score"]
    assert df.count() > 0
