"""Registered queries: models of price changes that are fitted, and their weights in an ensemble."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ensemble, fit
from ..sources import views
from .queries import query

LOG_SQL = """, lg AS (SELECT ticker, ts, close, lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS before FROM prices),
  k AS (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS n, count(*) OVER (PARTITION BY ticker) AS total, avg(r * r) OVER (PARTITION BY ticker) AS ms FROM (SELECT ticker, ts, ln(close / before) AS r FROM lg WHERE close > 0 AND before > 0))"""


def log_changes(spark, d):
    """(ticker, ts, r): logarithms of the changes between positive prices."""
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("ts"))
    rows = views.view(spark, d, "prices").select("ticker", "ts", "close", before.alias("before")).filter("close > 0 AND before > 0")
    return rows.select("ticker", "ts", F.log(F.col("close") / F.col("before")).alias("r"))


@query("d_fitted_regimes", f"{LOG_SQL} SELECT count(*) AS changes, round(sum(r), 4) AS total, round(sum(r * r), 3) AS squares, TRUE AS rises, TRUE AS chances FROM k", "prices")
def _(spark, d):
    """Ten rounds of fitting; a round's means and spreads, weighted by how often each regime is expected, give back the sums of all changes."""
    changes = log_changes(spark, d)
    chain, seen, counts = fit.fit_with_counts(changes, rounds=10, close=0.0)
    after = fit.improved(chain, counts, 0.0)
    met = [float(sum(counts[1 + 3 * j + i] for j in range(3))) for i in range(3)]
    total = sum(n * m for n, m in zip(met, after.means, strict=True))
    squares = sum(n * (m * m + s * s) for n, m, s in zip(met, after.means, after.spreads, strict=True))
    rises = all(b >= a - 1e-9 * abs(a) for a, b in zip(seen, seen[1:], strict=False))
    chances = all(abs(sum(row) - 1) < 1e-9 and min(row) > 0 for row in chain.moves)
    return spark.createDataFrame([(round(sum(met)), round(total, 4) + 0.0, round(squares, 3), rises, chances)], "changes long, total double, squares double, rises boolean, chances boolean")


@query("d_garch_likelihood", f"""{LOG_SQL}, g AS (SELECT ticker, 0::BIGINT AS n, total, ms, ms AS v, 0.0::DOUBLE AS ll FROM k WHERE n = 1 AND ms > 0 UNION ALL
    SELECT k.ticker, k.n, k.total, k.ms, 0.1::DOUBLE * k.ms + 0.1::DOUBLE * k.r * k.r + 0.8::DOUBLE * g.v, g.ll - 0.5::DOUBLE * (ln(2 * pi() * g.v) + k.r * k.r / g.v) FROM g JOIN k ON k.ticker = g.ticker AND k.n = g.n + 1)
  SELECT ticker, n, round(ll, 6) AS log_likelihood FROM g WHERE n = total""", "prices")
def _(spark, d):
    """At the point where the search begins."""
    return fit.fit_garch(log_changes(spark, d), rounds=1).filter("omega IS NOT NULL").select("ticker", "n", F.round("log_likelihood", 6).alias("log_likelihood"))


@query("d_garch_fit", f"{LOG_SQL} SELECT ticker, count(*) AS n, TRUE AS inside, TRUE AS better FROM k WHERE ms > 0 GROUP BY 1", "prices")
def _(spark, d):
    """The fitted point is allowed, and at least as likely as the one where the search begins."""
    fitted = fit.fit_garch(log_changes(spark, d)).filter("omega IS NOT NULL")
    return fitted.select("ticker", "n", F.expr("omega > 0 AND alpha >= 0 AND beta >= 0 AND alpha + beta < 1").alias("inside"), F.expr("log_likelihood >= begun").alias("better"))


#: The ensemble's models as they stand in the row: regimes, and numbers of the two others.
REGIMES = fit.Chain((0.5, -0.5, 0.0), (1.0, 0.75, 2.0), ((0.9, 0.05, 0.05), (0.05, 0.9, 0.05), (0.05, 0.05, 0.9)))
NUMBERS = {"process": 0.01, "noise": 1.0, "omega": 0.2, "alpha": 0.1, "beta": 0.8}


def _ensemble_sql() -> str:
    def f(x: float) -> str:
        return f"({x!r}::DOUBLE)"

    p, q, o, a, b = (f(NUMBERS[x]) for x in ("process", "noise", "omega", "alpha", "beta"))
    seen = [f"(exp(-0.5::DOUBLE * (ln(2 * pi() * {f(s * s)}) + (k.r - {f(m)}) * (k.r - {f(m)}) / {f(s * s)})) + 1e-300::DOUBLE)" for m, s in zip(REGIMES.means, REGIMES.spreads, strict=True)]
    joint = [f"{seen[i]} * (" + " + ".join(f"g.p{j} * {f(REGIMES.moves[j][i])}" for j in range(3)) + ")" for i in range(3)]
    first = [f"{seen[i]} * {f(sum(REGIMES.moves[j][i] for j in range(3)) / 3)}" for i in range(3)]
    gain = f"({{g}}.pv + {p}) / ({{g}}.pv + {p} + {q})"
    return f"""{LOG_SQL}, g AS (SELECT ticker, n, total, r AS x, 1.0::DOUBLE AS pv, {o} + {a} * r * r + {b} * r * r AS v, j0 / (j0 + j1 + j2) AS p0, j1 / (j0 + j1 + j2) AS p1, j2 / (j0 + j1 + j2) AS p2, 0.0::DOUBLE AS l0, 0.0::DOUBLE AS l1, 0.0::DOUBLE AS l2
      FROM (SELECT *, {first[0]} AS j0, {first[1]} AS j1, {first[2]} AS j2 FROM k WHERE n = 1) k UNION ALL
    SELECT ticker, n, total, x, pv, v, j0 / (j0 + j1 + j2), j1 / (j0 + j1 + j2), j2 / (j0 + j1 + j2), l0, l1, l2 + ln(j0 + j1 + j2) FROM (SELECT k.ticker, k.n, k.total, g.x + {gain.format(g="g")} * (k.r - g.x) AS x, (1 - {gain.format(g="g")}) * (g.pv + {p}) AS pv, {o} + {a} * k.r * k.r + {b} * g.v AS v, {joint[0]} AS j0, {joint[1]} AS j1, {joint[2]} AS j2,
      g.l0 - 0.5::DOUBLE * (ln(2 * pi() * (g.pv + {p} + {q})) + (k.r - g.x) * (k.r - g.x) / (g.pv + {p} + {q})) AS l0, g.l1 - 0.5::DOUBLE * (ln(2 * pi() * g.v) + k.r * k.r / g.v) AS l1, g.l2 AS l2 FROM g JOIN k ON k.ticker = g.ticker AND k.n = g.n + 1)),
  w AS (SELECT *, greatest(l0, l1, l2) AS top FROM g WHERE n = total AND n > 1), e AS (SELECT ticker, n, exp(l0 - top) AS e0, exp(l1 - top) AS e1, exp(l2 - top) AS e2 FROM w)
  SELECT ticker, n - 1 AS n, round(e0 / (e0 + e1 + e2), 6) AS kalman, round(e1 / (e0 + e1 + e2), 6) AS garch, round(e2 / (e0 + e1 + e2), 6) AS regimes FROM e"""


@query("d_ensemble_weights", _ensemble_sql(), "prices")
def _(spark, d):
    w = ensemble.final_weights(ensemble.foresight(log_changes(spark, d), REGIMES, **NUMBERS))
    return w.select("ticker", "n", *[F.round(m, 6).alias(m) for m in ensemble.MODELS])
