"""The whole analysis of one question, and its walk-forward backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import committee, compress, evaluate, filters
from . import loop, planner


def analyze(evidence: DataFrame, prices: DataFrame, query: str, ticker: str, as_of: Column, *, budget: int = 4000, rounds: int = 3, progress=None) -> dict:
    """Plan, retrieve, compress and decide: a dict of small results.

    prices: (ticker, ts, close).  The price is the last one known at ``as_of``.
    ``progress`` is called with a stage, start or complete, and a dict about it.
    """
    if progress:
        progress("start", {"ticker": ticker, "query": query})
    spark = evidence.sparkSession
    asked = spark.createDataFrame([(ticker, query)], "ticker string, query string")
    known = filters.as_of(evidence, as_of)
    research = loop.run(known, query, ticker, as_of, rounds=rounds)
    chosen = known.filter(F.col("id").isin(research.ids)) if research.ids else known.filter(F.upper("ticker") == ticker.upper())
    context = compress.compress(chosen.withColumn("ticker", F.lit(ticker.upper())), query, as_of, group=["ticker"], budget=budget)
    price = prices.filter((F.upper("ticker") == ticker.upper()) & (F.col("ts") <= as_of)).groupBy().agg(F.max_by("close", "ts").alias("price")).withColumn("ticker", F.lit(ticker.upper()))
    decision = committee.judge(context, price)
    if progress:
        progress("complete", {"ticker": ticker, "evidence": len(research.curated), "coverage": research.coverage})
    return {"plan": planner.plan(asked), "research": research, "context": context, "decision": decision, "citations": committee.citations(context)}


def calls_by_date(evidence: DataFrame, prices: DataFrame, dates: DataFrame) -> DataFrame:
    """A recommendation for every ticker on every date, from what was known then.

    dates: (as_of), the evaluation dates, which the driver holds.  Each row of evidence and
    each price counts once, for the first date that knows it; sums and last prices then
    run on over the dates, of which a ticker has a row each.
    """
    days = sorted({r["as_of"] for r in dates.select(F.col("as_of").cast("timestamp_ntz").alias("as_of")).collect()})
    known_at = F.array(*[F.lit(x).cast("timestamp_ntz") for x in days])

    def first(ts: str) -> Column:
        return F.size(F.filter(known_at, lambda x: x < F.col(ts)))

    sums = committee.weights(evidence.filter(F.col("published") <= F.lit(days[-1]).cast("timestamp_ntz")).withColumn("ticker", F.struct("ticker", first("published").alias("day"))))
    closes = prices.withColumn("day", first("ts")).filter(F.col("day") < len(days)).groupBy("ticker", "day").agg(F.max_by("close", "ts").alias("close"))
    sums = sums.select("ticker.ticker", "ticker.day", "bull", "bear")
    # a row for each ticker and date from its first evidence on, and the prices before that
    grid = sums.groupBy("ticker").agg(F.min("day").alias("since")).withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(len(days) - 1))))
    w = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.join(sums, ["ticker", "day"], "left").join(closes, ["ticker", "day"], "left")
    rows = rows.select("ticker", "day", "since", *[F.sum(F.coalesce(c, F.lit(0.0))).over(w).alias(c) for c in ("bull", "bear")], F.last("close", ignorenulls=True).over(w).alias("price")).filter("day >= since")
    keyed = rows.withColumn("ticker", F.struct("ticker", F.element_at(known_at, F.col("day") + 1).alias("as_of")))
    return committee.decide(keyed.select("ticker", "bull", "bear"), keyed.select("ticker", "price")).select("ticker.ticker", F.col("ticker.as_of").alias("created_at"), "rating", "conviction", F.col("price").alias("initial_price"))


def backtest(evidence: DataFrame, prices: DataFrame, dates: DataFrame, *, mode: str = "latest", window_days: int = 30) -> DataFrame:
    """Totals for each ticker of the calls on all dates, judged by later prices."""
    calls = calls_by_date(evidence, prices, dates).withColumn("prediction_id", F.xxhash64("ticker", "created_at")).withColumn("window_days", F.lit(window_days))
    return evaluate.backtest_totals(evaluate.judged(evaluate.realized(calls, prices, mode=mode)))
