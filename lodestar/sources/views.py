"""Views that put the synthetic tables into the evidence model.

Each is one SQL text that Spark and DuckDB both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables

EVIDENCE = """
SELECT CAST(d.doc_id AS BIGINT) AS id, substring(d.text, 1, 80) AS title, d.text AS content, upper(d.source) AS ticker,
  CASE CAST(floor(CAST(d.doc_id AS DOUBLE) / 7) AS BIGINT) % 14 WHEN 0 THEN 'reddit' WHEN 1 THEN 'twitter_x' WHEN 2 THEN 'stocktwits' WHEN 3 THEN 'sec_filing'
    WHEN 4 THEN 'earnings_transcript' WHEN 5 THEN 'financial_news' WHEN 6 THEN 'govt_announcement' WHEN 7 THEN 'company_blog' WHEN 8 THEN 'github_commits'
    WHEN 9 THEN 'job_postings' WHEN 10 THEN 'market_prices' WHEN 11 THEN 'financial_statements' WHEN 12 THEN 'macro_data' ELSE 'other' END AS source_type,
  CASE WHEN d.doc_id % 11 = 0 THEN 'verified_official' WHEN l.quality = 1 THEN 'high' WHEN l.quality = 0 THEN 'low' ELSE 'medium' END AS credibility,
  CAST(0.3 AS DOUBLE) + CAST(d.doc_id % 67 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  CASE CAST(floor(CAST(d.doc_id AS DOUBLE) / 20) AS BIGINT) % 5 WHEN 0 THEN 'very_bearish' WHEN 1 THEN 'bearish' WHEN 2 THEN 'neutral'
    WHEN 3 THEN 'bullish' ELSE 'very_bullish' END AS sentiment,
  e.ts AS published
FROM {documents} d LEFT JOIN {events} e ON e.event_id = d.doc_id LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""
PRICES = """
SELECT user_id AS ticker, ts, event_id AS seq, value AS close, CAST(event_id % 1000 + 1 AS BIGINT) AS volume FROM {events}
"""
FACTS = """
SELECT o_custkey AS entity, CASE o_custkey % 4 WHEN 0 THEN 'Revenues' WHEN 1 THEN 'SalesRevenueNet' WHEN 2 THEN 'NetIncomeLoss' ELSE 'Assets' END AS base_concept,
  CASE o_orderkey % 3 WHEN 0 THEN 'Revenues' WHEN 1 THEN 'SalesRevenueNet' ELSE 'NetIncomeLoss' END AS concept,
  CASE WHEN o_orderkey % 7 = 0 THEN 'shares' ELSE 'USD' END AS unit,
  o_orderkey AS filed, o_orderdate AS end_date, o_totalprice AS value, CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END AS form
FROM {orders}
"""
PREDICTIONS = """
SELECT o_orderkey AS prediction_id, o_custkey AS ticker, o_orderdate AS created_at,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'STRONG_BUY' WHEN '2' THEN 'BUY' WHEN '3' THEN 'HOLD' WHEN '4' THEN 'SELL' ELSE 'STRONG_SELL' END AS rating,
  CAST(o_orderkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS conviction, o_totalprice AS initial_price,
  lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS realized_price
FROM {orders}
"""
TABLES = {"evidence": (EVIDENCE, ["documents", "events", "labels"]), "prices": (PRICES, ["events"]), "facts": (FACTS, ["orders"]), "predictions": (PREDICTIONS, ["orders"])}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = TABLES[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def texts(spark: SparkSession, sf_dir: str, *, ticker: bool = False) -> DataFrame:
    """(id, title, content) of the evidence view, and ticker if asked for, as many rows as it has, without sending texts through its joins.

    A document comes once for each of its events and labels: only those with several are joined.
    """
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("content"), *([F.upper("source").alias("ticker")] if ticker else []))
    for name, key in (("events", "event_id"), ("labels", "doc_id")):
        several = table(spark, sf_dir, name).groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("id IS NOT NULL AND n > 1")
        if several.isEmpty():
            continue
        several, hint = tables.few_or_saved(several)
        rows = rows.join(hint(several), "id", "left").withColumn("n", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1)).cast("int")))).drop("n")
    return rows


def ctes(*names: str) -> str:
    """The same views as common table expressions for DuckDB, without WITH."""
    return ", ".join(f"{n} AS ({TABLES[n][0].format(**{t: t for t in TABLES[n][1]})})" for n in names)
