"""Company filings: nested facts, recent filings, statements, news feeds and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import text as X

ENTRY = "array<struct<val:double,end:string,start:string,form:string,fy:int,fp:string,filed:string,frame:string>>"
RAW = f"struct<facts:map<string,map<string,struct<units:map<string,{ENTRY}>>>>>"


def concept_table(concepts: dict | None = None) -> list[tuple[str, str, str, int]]:
    """(statement, metric, concept, priority)."""
    return [(st, m, c, i) for st, metrics in (concepts or S.CONCEPTS).items() for m, names in metrics.items() for i, c in enumerate(names)]


def flatten_facts(raw: DataFrame, *, json: str = "json", key: str = "ticker", taxonomy: str = "us-gaap") -> DataFrame:
    """Nested facts of each company, a row for each entry: key, concept, unit, value, end_date and so on."""
    f = raw.select(key, F.explode(F.from_json(json, RAW)["facts"][taxonomy]).alias("concept", "body"))
    f = f.select(key, "concept", F.explode("body.units").alias("unit", "entries")).select(key, "concept", "unit", F.inline("entries"))
    return f.select(
        key, "concept", "unit", F.col("val").alias("value"), F.col("end").alias("end_date"), F.col("start").alias("start_date"), "form",
        F.col("fy").alias("fiscal_year"), F.col("fp").alias("fiscal_period"), "filed", "frame",
    )


def select_facts(facts: DataFrame, key: str, *, concepts: dict | None = None, latest: int = 12, tie: str = "filed") -> DataFrame:
    """Entries of the first concept, and in it the first unit, that has periodic forms; the latest of them.

    Concepts and units are ranked by position; one min per (key, metric) picks them
    before any ordering, so only the chosen series are sorted.
    """
    spark = facts.sparkSession
    names = F.broadcast(spark.createDataFrame(concept_table(concepts), "statement string, metric string, concept string, concept_place int"))
    unit = F.array_position(F.array(*[F.lit(u) for u in S.UNITS]), F.col("unit"))
    rows = facts.filter(F.col("form").isin(S.FORMS)).join(names, "concept").withColumn("unit_place", unit).filter("unit_place > 0")
    group = Window.partitionBy(key, "statement", "metric")
    rows = rows.withColumn("choice", F.min(F.struct("concept_place", "unit_place")).over(group)).filter((F.col("choice.concept_place") == F.col("concept_place")) & (F.col("choice.unit_place") == F.col("unit_place")))
    rows = rows.withColumn("n", F.row_number().over(group.orderBy(F.desc("end_date"), tie))).filter(F.col("n") <= latest)
    return rows.drop("choice", "concept_place", "unit_place")


def latest_value(entries: DataFrame, group: Sequence[str], *, order: str = "end_date", tie: str = "filed") -> DataFrame:
    """The newest annual value, or else the newest of all."""
    first = Window.partitionBy(*group).orderBy((F.col("form") == "10-K").desc(), F.desc(order), tie)
    return entries.filter("value IS NOT NULL").withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def adjacent_growth(entries: DataFrame, group: Sequence[str], *, order: str = "end_date", tie: str = "filed") -> DataFrame:
    """Change from the last but one entry to the last."""
    w = Window.partitionBy(*group).orderBy(F.desc(order), tie)
    rows = entries.withColumn("n", F.row_number().over(w)).withColumn("before", F.lead("value").over(w)).filter("n = 1")
    return rows.select(*group, "value", "before", (F.try_divide("value", F.nullif("before", F.lit(0))) - 1).alias("growth"))


def ratios(facts: DataFrame, key: str) -> DataFrame:
    """Net margin, return on equity and on assets, liabilities to equity, from the latest values."""
    latest = latest_value(facts, [key, "metric"])
    wide = latest.groupBy(key).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("revenue", "net_income", "stockholders_equity", "total_assets", "total_liabilities")])

    def over(a: str, b: str, factor: float = 1.0) -> Column:
        return F.when((F.coalesce(F.col(a), F.lit(0.0)) != 0) & (F.coalesce(F.col(b), F.lit(0.0)) != 0), F.round(F.try_divide(a, b) * factor, 2))

    return wide.select(
        key, over("net_income", "revenue", 100).alias("net_margin"), over("net_income", "stockholders_equity", 100).alias("roe"),
        over("net_income", "total_assets", 100).alias("roa"), over("total_liabilities", "stockholders_equity").alias("debt_to_equity"),
    )


def recent_filings(companies: DataFrame, key: str, arrays: Sequence[str], forms: Sequence[str], most: int, *, scan: int = 100, form: str = "form") -> DataFrame:
    """Of each company's parallel arrays, the first ``most`` entries of the wanted forms among the first ``scan``."""
    rows = companies.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "e")).filter(F.col("pos") < scan).select(key, "pos", "e.*").filter(F.col(form).isin(list(forms)))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter(F.col("n") <= most).drop("n")


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik, F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def news(feeds: Sequence[DataFrame], terms: Sequence[str], cutoff: Column, *, per_feed: int = 50, most: int = 20) -> DataFrame:
    """Entries of all feeds that are recent and relevant, best first.

    Each feed gives its first ``per_feed`` entries by seq; undated ones are kept.
    """
    rows = None
    for i, f in enumerate(feeds):
        own = f.select("id", "title", "summary", "published", "seq", F.lit(i).alias("feed"))
        own = own.orderBy("seq").limit(per_feed)
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.filter(F.col("published").isNull() | (F.col("published") >= cutoff)).withColumn("relevance", X.news_relevance(F.col("title"), F.col("summary"), terms))
    return rows.filter("relevance > 0").orderBy(F.desc("relevance"), F.desc_nulls_last("published"), "id").limit(most)


def statement_periods(wide: DataFrame, key: str, period: str, items: Sequence[str]) -> DataFrame:
    """Wide statements as a map from item to value for each period; missing items are left out."""
    rows = wide.select(key, period, *[F.col(i).cast("double").alias(i) for i in items]).unpivot([key, period], list(items), "item", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy(key, period).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("item", "value")))).alias("items"))
