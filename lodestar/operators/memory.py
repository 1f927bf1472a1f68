"""What earlier research has stored: reports, cumulative evidence, and what is new since."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stores


def report_rollup(reports: DataFrame) -> DataFrame:
    """For each ticker: reports, distinct pieces of evidence, the time of the last report."""
    ids = reports.select("ticker", "ts", F.explode_outer("evidence_ids").alias("id"))
    a = reports.groupBy("ticker").agg(F.count(F.lit(1)).alias("reports"), F.max("ts").alias("last_report"))
    return a.join(ids.groupBy("ticker").agg(F.count_distinct("id").alias("evidence")), "ticker")


def lookup(asked: DataFrame, rollup: DataFrame) -> DataFrame:
    """Asked tickers with known, last_report and how much is stored."""
    return asked.join(rollup, "ticker", "left").select("ticker", F.col("reports").isNotNull().alias("known"), "last_report", F.coalesce("evidence", F.lit(0)).alias("cached"))


def delta(evidence: DataFrame, rollup: DataFrame) -> DataFrame:
    """Evidence published after its ticker's last report; all of it where there is none."""
    return evidence.join(rollup.select("ticker", "last_report"), "ticker", "left").filter(F.col("last_report").isNull() | (F.col("published") > F.col("last_report"))).drop("last_report")


def merge(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    return stores.upsert([stored, fetched], "id")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    n = nodes.select("id").distinct()
    return edges.join(n.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(n.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(valid_edges(edges, nodes).agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")))


def tiers(evidence: DataFrame, unit: str = "week") -> DataFrame:
    """Evidence counted by period and ticker."""
    return evidence.groupBy("ticker", F.date_trunc(unit, F.col("published")).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))
