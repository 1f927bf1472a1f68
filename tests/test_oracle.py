"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

from lodestar.plans import extra_queries, model_queries, more_queries, stream_queries  # noqa: F401  they register their queries
from lodestar.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, name):
    got = q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(plain(v) for v in r) for r in got.select(*columns).collect()]
    if name not in q.ORACLE_SQL:
        return
    result = duck.execute(q.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_every_sql_has_a_query():
    assert set(q.ORACLE_SQL) <= set(q.QUERIES)
