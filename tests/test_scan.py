"""Recurrences as scans against the loops they stand for."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import market, quant, scan

START = dt.datetime(2024, 1, 1)


def prices(spark, series, parts=7):
    rows = [(t, START + dt.timedelta(hours=i), float(x) if x is not None else None) for t, xs in series.items() for i, x in enumerate(xs)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, close double").repartition(parts)


@pytest.fixture(scope="module", autouse=True)
def many_parts(spark):
    """Small tables would be dealt to a single task."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.fixture(scope="module")
def series():
    """One ticker has nearly all rows, so that it lies in several tasks; one has a single price, one begins with nulls."""
    rng = random.Random(5)
    return {"hot": [50 + 10 * rng.random() + i / 500 for i in range(9000)], "a": [rng.random() * 100 for _ in range(40)], "one": [7.0], "gaps": [None, 3.0, None, 4.0, 5.0], "": [1.0, 2.0]}


def known(xs):
    return [x for x in xs if x is not None]


def means(xs, a):
    out = [xs[0]]
    for x in xs[1:]:
        out.append(out[-1] * (1 - a) + x * a)
    return out


def test_hot_series_lies_in_several_tasks(spark, series):
    rows = scan._ordered(prices(spark, series), "ticker", ["ts"], "close", market.ema_step(0.1))
    assert rows.filter("key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_last_values(spark, series):
    p = prices(spark, series)
    got = {r.ticker: r.ema for r in market.ema_last(p, 12).collect()}
    assert got.keys() == series.keys()
    for t, xs in series.items():
        assert got[t] == pytest.approx(means(known(xs), 2 / 13)[-1])
    for r in market.macd(p).collect():
        f, s, g = *(means(known(series[r.ticker]), a) for a in (2 / 13, 2 / 27)), 0.0
        for x, y in list(zip(f, s, strict=True))[1:]:
            g = g * 0.8 + (x - y) * 0.2
        assert (r.macd, r.signal) == (pytest.approx(f[-1] - s[-1]), pytest.approx(g)) and r.histogram == pytest.approx(r.macd - r.signal)
    for r in quant.kalman(p).collect():
        xs = known(series[r.ticker])
        x, v = xs[0], 1.0
        for z in xs[1:]:
            gain = (v + 1e-3) / (v + 1e-3 + 1e-1)
            x, v = x + gain * (z - x), (1 - gain) * (v + 1e-3)
        assert (r.level, r.variance) == (pytest.approx(x), pytest.approx(v))


def test_running_values(spark, series):
    got = {}
    for r in market.ema(prices(spark, series), 12).collect():
        got.setdefault(r.ticker, []).append((r.ts, r.close, r.ema))
    for t, xs in series.items():
        rows = sorted(got[t])
        assert [c for _, c, _ in rows] == known(xs)
        assert np.allclose([e for *_, e in rows], means(known(xs), 2 / 13))


def test_regimes_and_variance(spark, series):
    p = prices(spark, series).withColumn("r", market.change())
    changes = {t: [b / a - 1 for a, b in zip(xs, xs[1:], strict=False)] for t, xs in ((t, known(xs)) for t, xs in series.items() if t != "gaps")}
    got = {r.ticker: r.variance for r in quant.garch(p).collect()}
    last = {r.ticker: (r.regime, r.probability) for r in quant.regimes(p).collect()}
    for t, rs in changes.items():
        if not rs:
            assert t not in got or got[t] is None
            continue
        v, probs = sum(r * r for r in rs) / len(rs), [1 / 3] * 3
        for r in rs:
            v = 1e-6 + 0.1 * r * r + 0.85 * v
            joint = [sum(q * (0.95 if i == j else 0.025) for j, q in enumerate(probs)) * (np.exp(-((r - m) ** 2) / (2 * s * s)) / s + 1e-300) for i, (m, s) in enumerate(quant.REGIMES.values())]
            probs = [j / sum(joint) for j in joint]
        assert got[t] == pytest.approx(v) and last[t][1] == pytest.approx(max(probs)) and last[t][0] == list(quant.REGIMES)[int(np.argmax(probs))]


def test_no_series_is_collected(spark, series):
    for df in (market.ema_last(prices(spark, series), 12), market.macd(prices(spark, series)), quant.kalman(prices(spark, series))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and re.search(r"rangepartitioning\(key", plan)
    assert market.ema_last(prices(spark, series).limit(0), 12).collect() == market.ema(prices(spark, series).limit(0), 12).collect() == []


def test_products_and_prefixes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 64, 65):
        m = rng.normal(size=(n, 3, 3))
        want = [m[0]]
        for x in m[1:]:
            want.append(x @ want[-1])
        assert np.allclose(scan.product(m, False), want[-1]) and np.allclose(scan.prefixes(m, False), want)
        assert np.allclose(scan.product(m * 1e-300, True), scan.scaled(want[-1])) and np.allclose(scan.prefixes(m * 1e200, True), [scan.scaled(w) for w in want])
