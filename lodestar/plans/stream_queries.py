"""Registered queries: evidence that arrives as a stream, with batches that come again and rows that are corrected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..operators import memory
from ..streaming import delta
from .queries import ev, query


def arrived(spark: SparkSession, d: str) -> delta.EvidenceLog:
    """All evidence, merged from two streams of which the first is then read again from its start.

    In the first a third of the rows are dated 30 days too early; the second corrects them.
    """
    folder = tables.shared_folder(spark)
    e = ev(spark, d)
    early = F.col("id") % 3 == 0
    e.withColumn("published", F.when(early, F.col("published") - F.expr("INTERVAL 30 DAYS")).otherwise(F.col("published"))).withColumn("revision", F.lit(1)).write.parquet(f"{folder}/first")
    e.filter(early).withColumn("revision", F.lit(2)).write.parquet(f"{folder}/second")
    log = delta.EvidenceLog(spark, f"{folder}/log")
    for i, name in enumerate(("first", "second", "first")):
        stream = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).parquet(f"{folder}/{name}")
        delta.merge_available(stream, log, f"{folder}/checkpoint-{i}", f"{name}-{i}")
    return log


@query("r3_stream_delta", ", last AS (SELECT ticker, max(published) - INTERVAL 3 DAY AS last_report FROM evidence GROUP BY 1) SELECT id FROM evidence JOIN last USING (ticker) WHERE published > last_report", "evidence")
def _(spark, d):
    e = arrived(spark, d).rows()
    return memory.delta(e, e.groupBy("ticker").agg((F.max("published") - F.expr("INTERVAL 3 DAYS")).alias("last_report"))).select("id")


@query("d13_stream_tiers", "SELECT ticker, date_trunc('week', published)::TIMESTAMP AS period, count(*) AS n, round(avg(confidence), 6) AS confidence FROM evidence GROUP BY 1, 2", "evidence")
def _(spark, d) -> DataFrame:
    t = arrived(spark, d).tiers()
    return t.select("ticker", F.col("period").cast("timestamp_ntz").alias("period"), "n", F.round("confidence", 6).alias("confidence"))
