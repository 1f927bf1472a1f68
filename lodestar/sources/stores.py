"""Stores: keyed upserts with tombstones, JSON in and out, and appended registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S


def upsert(versions: Sequence[DataFrame], key: str) -> DataFrame:
    """All rows by key, those of later tables in place of earlier ones."""
    rows = None
    for i, v in enumerate(versions):
        v = v.withColumn("__version", F.lit(i))
        rows = v if rows is None else rows.unionByName(v, allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("__version"))
    return rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "__version")


def without(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return rows.join(tombstones.select(key).distinct(), key, "left_anti")


def stats(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """One row: stored, deleted and live rows."""
    dead = tombstones.select(key).distinct().join(rows.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return rows.agg(F.count(F.lit(1)).alias("stored")).crossJoin(dead).select("stored", "deleted", (F.col("stored") - F.col("deleted")).alias("live"))


def store_record(evidence: DataFrame) -> DataFrame:
    """What an external vector store keeps beside a vector: short texts, epoch seconds, joined tags."""
    epoch = (F.unix_micros(F.col("published").cast("timestamp")) / 1_000_000).cast("long")
    tags = F.array_join(F.slice("tags", 1, 10), ",") if "tags" in evidence.columns else F.lit("")
    return evidence.select("id", F.substring("title", 1, 200).alias("title"), F.substring("content", 1, 500).alias("content"), "ticker", "source_type", epoch.alias("published_at"), tags.alias("tags"))


def store_filter(ticker: str | None = None, sources: Sequence[str] = (), since: float | None = None, until: float | None = None) -> Column:
    """A predicate on stored records."""
    out = F.lit(True)
    if ticker:
        out &= F.col("ticker") == ticker.upper()
    if sources:
        out &= F.col("source_type").isin(list(sources))
    if since is not None:
        out &= F.col("published_at") >= since
    if until is not None:
        out &= F.col("published_at") <= until
    return out


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, S.EVIDENCE)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, S.EDGE)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, S.PREDICTION)


def json_round_trip(df: DataFrame) -> DataFrame:
    """Rows as JSON texts and back, typed by their schema."""
    times = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    rows = df.select(F.to_json(F.struct(*df.columns), times | {"ignoreNullFields": "false"}).alias("j"))
    return rows.select(F.from_json("j", df.schema, times).alias("r")).select("r.*")


def append_registry(df: DataFrame, path: str) -> None:
    """Adds records; earlier ones are never rewritten."""
    df.write.mode("append").parquet(path)
