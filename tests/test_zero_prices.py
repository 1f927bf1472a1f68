"""Prices of 0, after which changes are infinite or no numbers, and prices that do not vary: queries against their SQL."""

import datetime

import duckdb
import pytest

from lodestar.plans import extra_queries, model_queries, more_queries, stream_queries  # noqa: F401  they register their queries
from lodestar.plans import queries as q

from test_oracle import plain

#: A single 0, two in a row, one at the end, none, one price only, a fall in each step.
SERIES = {1: [5, 4, 0, 3, 6, 7, 6], 2: [2, 3, 0, 0, 4, 5, 3, 4], 3: [3, 4, 6, 5, 0], 4: [5, 6, 4, 7, 8, 6], 5: [2, 2, 2, 2], 6: [9, 7, 6, 2], 7: [0, 3, 4, 2]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two sets of events: all series, and those without two zeros in a row."""
    out = {}
    for name, left in (("all", ()), ("single", (2,))):
        rows = [(k * 100 + i, datetime.datetime(2024, 1, 1 + i, 12, k), k, "view", float(x), None) for k, s in SERIES.items() if k not in left for i, x in enumerate(s)]
        out[name] = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{out[name]}/events.parquet")
    return out


@pytest.mark.parametrize("events", ["all", "single"])
@pytest.mark.parametrize("name", ["d_information_coefficient", "a10_price_features", "d_downside", "d_risk_measures", "d_garch", "d_regimes", "w6_pct_change", "w7_volatility", "s18_market_summary", "d_risk_parity", "d_signal_decay", "d_tail_loss"])
def test_against_sql(spark, folder, name, events):
    got = q.QUERIES[name](spark, folder[events])
    columns = sorted(got.columns)
    rows = [tuple(plain(v) for v in r) for r in got.select(*columns).collect()]
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder[events]}/events.parquet/*.parquet'")
    result = c.execute(q.ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    want = [tuple(plain(r[names.index(x)]) for x in columns) for r in result.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_changes_at_a_half_of_the_last_place(spark, tmp_path):
    """Changes by multiples of 1 / 5120 end at a half of the ninth place, or a little below it as doubles."""
    prices = [x for i in range(1, 5000) for x in (51.2, i / 100)]
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), 1, "view", x, None) for i, x in enumerate(prices)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.seq: r.r for r in q.QUERIES["w6_pct_change"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {seq: r for _, seq, r in c.execute(q.ORACLE_SQL["w6_pct_change"]).fetchall()}
    assert len(want) == len(prices) - 1 and got == want
