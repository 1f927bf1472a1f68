"""Weights of three models of price changes by how well each foresaw the changes so far, a step ahead and without leaks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fit, scan

MODELS = ("kalman", "garch", "regimes")


def normal_log_density(x: Column, mean: Column | float, variance: Column | float) -> Column:
    return -0.5 * (F.log(2 * F.pi() * variance) + (x - mean) * (x - mean) / variance)


def foresight(changes: DataFrame, chain: fit.Chain, *, process: float, noise: float, omega: float, alpha: float, beta: float, key: str = "ticker", order: str = "ts", value: str = "r") -> DataFrame:
    """(key, order, value, n, kalman, garch, regimes): log density that each model gave a change, knowing those before it.

    From a series' second change on; n is its place.  Kalman: a level that walks, started at the first
    change with variance 1.  GARCH: started at the first change's square.  Regimes: the
    chain, from equal chances before the first change.  States come from parallel scans;
    nulls are left out, and an order occurs once in a series.
    """
    r, d = F.col(value), len(chain.means)
    base = changes.select(key, order, value).filter(r.isNotNull())
    by = dict(key=key, order=(order,), value=value)
    level = scan.running(base, scan.numbers(noise, noise * process, 0, 1, process + noise, 0, r, process * r, noise), 3, lambda x: (1.0, 1.0, x), projective=True, **by)
    spread = scan.running(base, scan.numbers(beta, omega + alpha * r * r, 0, 1), 2, lambda x: (omega + alpha * x * x + beta * x * x, 1.0), **by)
    seen = [F.exp(normal_log_density(r, m, s * s)) + 1e-300 for m, s in zip(chain.means, chain.spreads, strict=True)]
    met = scan.running(base, scan.numbers(*[seen[i] * chain.moves[j][i] for i in range(d) for j in range(d)]), d, lambda x: _first(chain, x), projective=True, **by)
    rows = None
    for name, t in zip(MODELS, (level, spread, met), strict=True):
        t = t.select(key, order, *([value] if rows is None else []), F.col("state").alias(name))
        rows = t if rows is None else rows.join(t, [key, order])
    w = Window.partitionBy(key).orderBy(order)
    was = {m: F.lag(m).over(w) for m in MODELS}
    rows = rows.select(key, order, value, F.row_number().over(w).alias("n"), *[c.alias(m) for m, c in was.items()]).filter("n > 1")
    u, v, x = (F.get("kalman", F.lit(i)) for i in range(3))
    total = sum((F.get("regimes", F.lit(i)) for i in range(1, d)), F.get("regimes", F.lit(0)))
    chance = [sum((F.get("regimes", F.lit(j)) * chain.moves[j][i] for j in range(1, d)), F.get("regimes", F.lit(0)) * chain.moves[0][i]) / total for i in range(d)]
    mixed = sum((chance[i] * seen[i] for i in range(1, d)), chance[0] * seen[0])
    return rows.select(key, order, value, "n", normal_log_density(r, x / v, u / v + process + noise).alias("kalman"), normal_log_density(r, 0.0, F.get("garch", F.lit(0))).alias("garch"), F.log(mixed).alias("regimes"))


def _first(chain: fit.Chain, x: float) -> list[float]:
    """Chances of the regimes behind a first change, but for a common factor."""
    d = len(chain.means)
    seen = [math.exp(-0.5 * ((x - m) / s) ** 2) / s / math.sqrt(2 * math.pi) + 1e-300 for m, s in zip(chain.means, chain.spreads, strict=True)]
    out = [seen[i] * sum(chain.moves[j][i] for j in range(d)) / d for i in range(d)]
    return [v / max(out) for v in out]


def _columns() -> list[Column]:
    return [F.col(m) for m in MODELS]


def softmax(*logs: Column) -> list[Column]:
    top = F.greatest(*logs)
    e = [F.exp(x - top) for x in logs]
    return [x / sum(e[1:], e[0]) for x in e]


def final_weights(scores: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, n, kalman, garch, regimes): weights for the next change, of the sums of foresight(); n changes were foreseen."""
    sums = scores.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in MODELS])
    return sums.select(key, "n", *[w.alias(m) for m, w in zip(MODELS, softmax(*_columns()), strict=True)])


def walk_forward(scores: DataFrame, key: str = "ticker", order: str = "ts") -> DataFrame:
    """(key, order, kalman, garch, regimes, mixed): the weights before each change, from earlier ones only, and the log density that they gave it together.

    A series' first foreseen change has equal weights.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(m).over(w), F.lit(0.0)).alias(f"__{m}") for m in MODELS]
    rows = scores.select(key, order, *MODELS, *before)
    weights = softmax(*[F.col(f"__{m}") for m in MODELS])
    top = F.greatest(*_columns())
    mixed = top + F.log(sum((x * F.exp(m - top) for x, m in list(zip(weights, _columns(), strict=True))[1:]), weights[0] * F.exp(F.col(MODELS[0]) - top)))
    return rows.select(key, order, mixed.alias("mixed"), *[x.alias(m) for m, x in zip(MODELS, weights, strict=True)])
