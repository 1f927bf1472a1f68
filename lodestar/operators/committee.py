"""Bull and bear cases from evidence, and the recommendation weighed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as M
from . import filters

def case(evidence: DataFrame, side: Column, *, most: int = 5, seq: str = "id") -> DataFrame:
    """Of each ticker's evidence on one side: its count, ids in order, and the first labelled titles."""
    own = evidence.filter(side).withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy(seq)))
    label = F.concat(F.lit("["), F.upper("source_type"), F.lit("] "), "title")
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("n", label.alias("label"))))), lambda x: x["label"])
    return own.groupBy("ticker").agg(F.count(F.lit(1)).alias("signals"), F.transform(F.array_sort(F.collect_list(F.struct("n", seq))), lambda x: x[seq]).alias("ids"), first.alias("labels"))


def weights(evidence: DataFrame) -> DataFrame:
    """bull and bear: confidence summed by side, half as much again for verified sources."""
    w = F.col("confidence") * F.when(F.col("credibility") == "verified_official", 1.5).otherwise(1.0)
    return evidence.groupBy("ticker").agg(F.sum(F.when(filters.is_bullish(), w).otherwise(0.0)).alias("bull"), F.sum(F.when(filters.is_bearish(), w).otherwise(0.0)).alias("bear"))


def judge(evidence: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """One recommendation for each ticker.

    prices: (ticker, price); a ticker without one counts as 100.
    """
    return decide(weights(evidence), prices)


def decide(weighed: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """judge() from the weights of both sides: (ticker, bull, bear)."""
    r = weighed.withColumn("ratio", M.strength_ratio(F.col("bull"), F.col("bear")))
    r = r.join(prices, "ticker", "left") if prices is not None else r.withColumn("price", F.lit(None).cast("double"))
    r = r.withColumn("price", F.coalesce(F.nanvl("price", F.lit(None).cast("double")), F.lit(100.0)))
    up, down = F.round(F.col("price") * 1.25, 2), F.round(F.col("price") * 0.85, 2)
    r = r.withColumn("upside", up).withColumn("downside", down).withColumn("rating", M.rating(F.col("ratio"))).withColumn("conviction", M.conviction(F.col("ratio")))
    gain = F.when(F.col("upside") != 0, F.abs(F.col("upside") - F.col("price"))).otherwise(20.0)
    risk = F.when(F.col("downside") != 0, F.abs(F.col("price") - F.col("downside"))).otherwise(15.0)
    allocation = (
        F.when(F.col("rating").isin("BUY", "STRONG_BUY"), "Overweight (3-5% Portfolio Allocation)")
        .when(F.col("rating").isin("SELL", "STRONG_SELL"), "Underweight / Exit")
        .otherwise("Neutral (1-2% Portfolio Allocation)")
    )
    return r.select(
        "ticker", "bull", "bear", "ratio", "rating", "conviction", "price", F.round(F.col("price") * 0.95, 2).alias("entry_low"), F.round(F.col("price") * 1.02, 2).alias("entry_high"),
        "upside", "downside", F.round(gain / F.greatest(risk, F.lit(1.0)), 2).alias("risk_reward"), allocation.alias("allocation"),
    )


def citations(evidence: DataFrame) -> DataFrame:
    """The citations of each ticker, in order of id."""
    own = [F.col(c) if c in evidence.columns else F.lit(None).cast("string").alias(c) for c in ("author", "url")]
    return evidence.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("id", "title", "source_type", *own, "credibility", "confidence"))).alias("citations"))
