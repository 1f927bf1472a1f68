"""Fitted regimes and volatility against plain recursions and generated series."""

import numpy as np
import pandas as pd
import pytest

from lodestar.operators import fit, quant

CHAIN = fit.Chain((0.02, -0.03, 0.0), (0.01, 0.02, 0.06), ((0.95, 0.03, 0.02), (0.04, 0.92, 0.04), (0.05, 0.05, 0.9)))


def table(spark, series):
    rows = pd.concat([pd.DataFrame({"ticker": k, "ts": np.arange(len(r)), "r": np.asarray(r, float)}) for k, r in series.items()])
    return spark.createDataFrame(rows.sample(frac=1, random_state=1))


def generated(chain, n, seed):
    rng = np.random.default_rng(seed)
    s, out = int(rng.integers(3)), []
    for _ in range(n):
        s = int(rng.choice(3, p=chain.moves[s]))
        out.append(rng.normal(chain.means[s], chain.spreads[s]))
    return np.array(out)


def plain_counts(chain, series):
    """Forward and backward, a step at a time."""
    d, a, mean, spread = 3, np.array(chain.moves), np.array(chain.means), np.array(chain.spreads)
    out = np.zeros(1 + d * d + 2 * d)
    for r in series:
        b = np.exp(-0.5 * ((r[:, None] - mean) / spread) ** 2) / spread / np.sqrt(2 * np.pi)
        alpha, log = [np.full(d, 1 / d)], 0.0
        for x in b:
            v = (alpha[-1] @ a) * x
            log += np.log(v.sum())
            alpha.append(v / v.sum())
        beta = np.ones(d)
        out[0] += log
        for t in range(len(r) - 1, -1, -1):
            xi = alpha[t][:, None] * a * (b[t] * beta)[None, :]
            xi /= xi.sum()
            dev = r[t] - mean
            out[1:10] += xi.ravel()
            out[10:13] += xi.sum(0) * dev
            out[13:16] += xi.sum(0) * dev**2
            beta = a @ (b[t] * beta)
            beta /= beta.max()
    return out


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_expected_counts_are_those_of_forward_and_backward(spark, size):
    series = {f"k{i}": generated(CHAIN, n, i) for i, n in enumerate((1, 2, 50, 133, 300))}
    cut = fit.chunks(table(spark, series), size=size)
    np.testing.assert_allclose(fit.expected_counts(cut, CHAIN), plain_counts(CHAIN, series.values()), rtol=1e-8, atol=1e-8)


def test_series_that_cross_a_batch_stay_in_one_row_and_are_summed_where_they_lie(spark):
    series = {f"k{i:02d}": generated(CHAIN, 5 + i % 3, i) for i in range(40)}
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        cut = fit.chunks(table(spark, series)).collect()
        counts = fit.expected_counts(fit.chunks(table(spark, series)), CHAIN)
    finally:
        spark.conf.set(name, before)
    # only a part's first and last series may go on elsewhere
    parts = {r["part"] for r in cut}
    assert len(cut) <= 40 + len(parts) and sum(not r["whole"] for r in cut) <= 2 * len(parts)
    assert {r["key"]: r["values"] for r in cut if r["whole"]} == {r["key"]: series[r["key"]].tolist() for r in cut if r["whole"]}
    np.testing.assert_allclose(counts, plain_counts(CHAIN, series.values()), rtol=1e-8, atol=1e-8)


def test_far_values_do_not_underflow(spark):
    series = {"a": np.array([0.0, 500.0, -500.0, 0.01])}
    counts = fit.expected_counts(fit.chunks(table(spark, series)), CHAIN)
    assert np.isfinite(counts).all() and abs(counts[1:10].sum() - 4) < 1e-9


def test_likelihood_rises_and_the_generating_chain_comes_back(spark):
    # one series has most of the rows, and lies in many chunks
    series = {"hot": generated(CHAIN, 12_000, 1)} | {f"s{i}": generated(CHAIN, 400, 10 + i) for i in range(10)}
    chain, seen = fit.fit_regimes(table(spark, series), rounds=25, size=1000)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0]
    order = np.argsort(chain.spreads)
    np.testing.assert_allclose(np.array(chain.means)[order], CHAIN.means, atol=0.005)
    np.testing.assert_allclose(np.array(chain.spreads)[order], CHAIN.spreads, rtol=0.1)
    np.testing.assert_allclose(np.array(chain.moves)[np.ix_(order, order)].diagonal(), np.diag(CHAIN.moves), atol=0.03)


def test_nulls_ties_and_empty_series(spark):
    schema = "ticker string, ts long, r double"
    assert fit.fit_regimes(spark.createDataFrame([], schema))[1] == [0.0]
    same = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.5), (None, 2, 0.5), ("a", 3, None), ("a", 4, float("nan")), ("a", 5, float("inf"))], schema)
    chain, seen = fit.fit_regimes(same, rounds=3)
    assert np.isfinite(chain.means).all() and np.isfinite(seen).all() and min(chain.spreads) >= 1e-9
    assert fit.chunks(same).count() == 2  # a null key is a series of its own


def test_regimes_by_a_fitted_chain(spark):
    series = {f"k{i}": generated(CHAIN, 200, i) for i in range(4)}
    got = {r["ticker"]: (r["regime"], r["probability"]) for r in quant.regimes(table(spark, series), chain=CHAIN).collect()}
    for k, r in series.items():
        p = np.full(3, 1 / 3)
        for x in r:
            p = (p @ np.array(CHAIN.moves)) * np.exp(-0.5 * ((x - np.array(CHAIN.means)) / np.array(CHAIN.spreads)) ** 2) / np.array(CHAIN.spreads)
            p /= p.sum()
        assert got[k] == (list(quant.REGIMES)[int(p.argmax())], pytest.approx(p.max()))


def garch_series(omega, alpha, beta, n, seed):
    rng = np.random.default_rng(seed)
    v, out = omega / (1 - alpha - beta), []
    for _ in range(n):
        out.append(rng.normal(0, np.sqrt(v)))
        v = omega + alpha * out[-1] ** 2 + beta * v
    return np.array(out)


def garch_likelihood(r, omega, alpha, beta):
    v, out = np.mean(r**2), 0.0
    for x in r:
        out -= 0.5 * (np.log(2 * np.pi * v) + x * x / v)
        v = omega + alpha * x * x + beta * v
    return out


def test_fitted_volatility_is_the_likeliest_and_comes_back(spark):
    true = {"hot": (2e-6, 0.12, 0.8), "b": (1e-3, 0.3, 0.5)}
    series = {k: garch_series(*p, 40_000, i + 3) for i, (k, p) in enumerate(true.items())}
    got = {r["ticker"]: r for r in fit.fit_garch(table(spark, series), size=3000).collect()}
    for k, p in true.items():
        r = got[k]
        fitted = (r["omega"], r["alpha"], r["beta"])
        np.testing.assert_allclose(fitted, p, rtol=0.1)
        best = garch_likelihood(series[k], *fitted)
        assert r["log_likelihood"] == pytest.approx(best, rel=1e-9) and r["n"] == 40_000
        # no point beside it is likelier
        for i in range(3):
            for f in (0.98, 1.02):
                beside = [x * (f if i == j else 1) for j, x in enumerate(fitted)]
                assert garch_likelihood(series[k], *beside) <= best + 1e-3


def test_chunks_do_not_change_the_fit(spark):
    series = {f"k{i}": garch_series(1e-4, 0.2, 0.7, n, i) for i, n in enumerate((300, 501, 64))}
    fits = [{r["ticker"]: r for r in fit.fit_garch(table(spark, series), size=s).collect()} for s in (16, 4096)]
    for k in series:
        for c in ("omega", "alpha", "beta", "log_likelihood"):
            assert fits[0][k][c] == pytest.approx(fits[1][k][c], rel=1e-6)


def test_volatility_of_short_flat_and_null_series(spark, monkeypatch):
    schema = "ticker string, ts long, r double"
    assert fit.fit_garch(spark.createDataFrame([], schema)).collect() == []
    rows = [("one", 1, 0.1), ("flat", 1, 0.0), ("flat", 2, 0.0), (None, 1, 0.1), (None, 2, -0.3), (None, 2, -0.3), ("none", 1, None)]
    monkeypatch.setattr(fit.tables, "is_small", lambda df: False)
    got = {r["ticker"]: r for r in fit.fit_garch(spark.createDataFrame(rows, schema), rounds=8).collect()}
    assert set(got) == {"one", "flat", None} and got["flat"]["omega"] is None and got[None]["n"] == 3
    for k in ("one", None):
        r = got[k]
        assert r["omega"] > 0 and 0 < r["alpha"] + r["beta"] < 1 and np.isfinite(r["log_likelihood"])


def test_ensemble_weights_walk_forward_without_leaks(spark):
    from lodestar.operators import ensemble
    from lodestar.plans.model_queries import NUMBERS, REGIMES

    rng = np.random.default_rng(5)
    series = {f"k{i}": rng.normal(0, 1 + i, 40) for i in range(3)}
    changed = {k: np.concatenate([r[:-1], [99.0]]) for k, r in series.items()}
    scores = ensemble.foresight(table(spark, series), REGIMES, **NUMBERS)
    walk = {(r["ticker"], r["ts"]): r for r in ensemble.walk_forward(scores).collect()}
    other = {(r["ticker"], r["ts"]): r for r in ensemble.walk_forward(ensemble.foresight(table(spark, changed), REGIMES, **NUMBERS)).collect()}
    for at, r in walk.items():
        weights = [r[m] for m in ensemble.MODELS]
        assert sum(weights) == pytest.approx(1)
        # what comes later, and the change itself, do not move a weight
        assert weights == pytest.approx([other[at][m] for m in ensemble.MODELS], rel=1e-9, abs=1e-12)
        if at[1] == 1:
            assert weights == pytest.approx([1 / 3] * 3)
    one = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None)], "ticker string, ts long, r double")
    assert ensemble.foresight(one, REGIMES, **NUMBERS).collect() == []


def test_short_series_are_fitted_without_a_table_for_each_round(spark, monkeypatch):
    series = {f"k{i}": garch_series(1e-4, 0.2, 0.7, 30 + 7 * i, i) for i in range(12)}
    saved, save = [], fit.tables.save
    monkeypatch.setattr(fit.tables, "save", lambda *a, **b: saved.append(1) or save(*a, **b))
    got = {r["ticker"]: r for r in fit.fit_garch(table(spark, series)).collect()}
    assert len(saved) <= 3
    for k, r in series.items():
        assert got[k]["log_likelihood"] == pytest.approx(garch_likelihood(r, *(got[k][c] for c in ("omega", "alpha", "beta"))), rel=1e-9)
        assert got[k]["begun"] == pytest.approx(garch_likelihood(r, 0.1 * np.mean(r**2), 0.1, 0.8), rel=1e-9) and got[k]["begun"] <= got[k]["log_likelihood"]
