"""Rows that are generated: synthetic prices, simulated paths, constants that stand in for missing feeds."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def synthetic_prices(tickers: DataFrame, days: int, start: date, *, ticker: str = "ticker", base: float = 100.0, drift: float = 4e-4, spread: float = 0.018) -> DataFrame:
    """A geometric random walk of daily open, high, low, close and volume for each ticker.

    Every number is a hash of (ticker, day), so reruns and repartitioning agree.
    """
    t = tickers.select(F.col(ticker).cast("string").alias("ticker")).distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    step = drift + spread * normal("ticker", "day")
    path = F.exp(F.sum(step).over(Window.partitionBy("ticker").orderBy("day")))
    t = t.withColumn("close", base * path)
    return t.select(
        "ticker", F.date_add(F.lit(start), F.col("day")).alias("ts"), (F.col("close") * 0.995).alias("open"), (F.col("close") * 1.015).alias("high"),
        (F.col("close") * 0.985).alias("low"), "close", (5_000_000 + F.floor(uniform("ticker", "day", 9) * 45_000_000)).cast("long").alias("volume"),
    )


def uniform(*key) -> Column:
    """A number from 0 to 1 (both excluded) for each key: 52 bits of its MD5, which any engine can compute."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else F.lit(k)).cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / (1 << 52)


def normal(*key) -> Column:
    """A standard normal number for each key, by Box-Muller."""
    return F.sqrt(-2 * F.log(uniform(*key, 1))) * F.cos(2 * F.pi() * uniform(*key, 2))


def fan(spark: SparkSession, price: float, drift: float, spread: float, *, paths: int = 25, steps: int = 60, seed: int = 0) -> DataFrame:
    """Simulated paths, and for each step their 5th percentile, median and 95th percentile."""
    p = spark.range(paths).withColumnRenamed("id", "path").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    r = p.withColumn("r", (drift - spread * spread / 2) + spread * normal("path", "step", seed))
    r = r.withColumn("price", price * F.exp(F.sum("r").over(Window.partitionBy("path").orderBy("step"))))
    at = F.sort_array(F.collect_list("price"))
    return r.groupBy("step").agg(F.get(at, F.lit(int(0.05 * paths))).alias("p05"), F.get(at, F.lit(paths // 2)).alias("median"), F.get(at, F.lit(int(0.95 * paths))).alias("p95"))


#: Fixed values of the macro reading.
MACRO = {"cpi": 2.7, "fed_funds": 4.75, "gdp": 2.8, "brent": 76.5, "gold": 2420.0, "vix": 16.2, "usd_inr": 83.9}


def macro_sentiment() -> Column:
    """What the columns vix and fed_funds mean: high volatility is bearish, low rates bullish."""
    return F.when(F.col("vix") > 25, "bearish").when(F.col("fed_funds") < 3, "bullish").otherwise("neutral")


def macro_reading(spark: SparkSession, **reading: float) -> DataFrame:
    """One row of macro numbers with the sentiment they mean."""
    row = MACRO | reading
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    return df.withColumn("sentiment", macro_sentiment())


def with_fallback(found: DataFrame, wanted: DataFrame, key: str, constants: dict) -> DataFrame:
    """``found``, and a row of constants for each wanted key that it lacks."""
    missing = wanted.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")
    filled = missing.select(key, *[F.lit(constants.get(c)).cast(found.schema[c].dataType).alias(c) for c in found.columns if c != key])
    return found.unionByName(filled.select(*found.columns))


def fresh(cached: DataFrame, fetched: DataFrame, key: str, now: Column, hours: float, *, cached_at: str = "cached_at") -> DataFrame:
    """Cached rows younger than ``hours``; for all other keys what was fetched."""
    valid = cached.filter(F.timestamp_diff("MICROSECOND", F.col(cached_at), now) < hours * 3600e6)
    return valid.drop(cached_at).unionByName(fetched.join(valid.select(key), key, "left_anti"))


def walk_forward(spark: SparkSession, first: date, last: date, step_days: int) -> DataFrame:
    """Evaluation dates from ``first`` to ``last``, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.make_dt_interval(F.lit(step_days)))).alias("as_of"))


def walk_forward_of(prices: DataFrame, step_days: int) -> DataFrame:
    """(ticker, as_of): evaluation dates of each ticker, from its first price's day to its last one's."""
    days = prices.groupBy("ticker").agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))
    return days.select("ticker", F.explode(F.sequence("first", "last", F.make_dt_interval(F.lit(step_days)))).alias("as_of"))


def fans(prices: DataFrame, drift: float, spread: float, *, steps: int = 60) -> DataFrame:
    """(ticker, step, p05, median, p95) of paths from each ticker's last price; all see the same shocks."""
    last = prices.groupBy("ticker").agg(F.max_by("close", "ts").alias("price"))
    # a row for each step
    shares = fan(prices.sparkSession, 1.0, drift, spread, steps=steps)
    return last.crossJoin(F.broadcast(shares)).select("ticker", "step", *[(F.col("price") * F.col(c)).alias(c) for c in ("p05", "median", "p95")])


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
