"""Whether retrieved evidence is enough: five scores, their composite, gaps and what to discard."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scores as M
from . import filters


def _has(bucket: str) -> Column:
    return F.max(F.col("source_type").isin(S.BUCKETS[bucket]).cast("int"))


def coverage(evidence: DataFrame, group: Sequence[str], as_of: Column, *, score: str = "score") -> DataFrame:
    """One row for each group of retrieved evidence: scores, coverage, sufficiency, gaps.

    All five dimensions come from one aggregate, combined before the shuffle.
    """
    days = M.days_between(F.col("published"), as_of)
    total = F.count(F.lit(1))
    a = evidence.groupBy(*group).agg(
        total.alias("n"), *[_has(b).alias(b) for b in S.BUCKETS],
        (F.count_if(filters.is_bullish()) / total).alias("bull"), (F.count_if(filters.is_bearish()) / total).alias("bear"),
        F.round(F.avg(F.coalesce(F.col(score), F.lit(0.0))), 4).alias("relevance"), F.round(F.avg(M.decay(days, S.DECAY)), 4).alias("recency"), F.avg("confidence").alias("mean_confidence"),
    )
    a = a.withColumn("diversity", (F.col("official") + F.col("news") + F.col("social") + F.col("alternative")) / 4)
    a = a.withColumn("balance", F.round(F.least(F.lit(1.0), F.least("bull", "bear") / S.BALANCE), 4))
    composite = F.col("diversity") * 0.25 + F.col("balance") * 0.20 + F.col("relevance") * 0.30 + F.col("recency") * 0.15 + F.least(F.lit(1.0), F.col("mean_confidence") / 0.8) * 0.10
    a = a.withColumn("coverage", F.round(F.least(F.lit(1.0), composite), 4))
    gaps = F.array(
        *[F.when(F.col(b) == 0, S.GAPS[b]) for b in ("official", "news", "social")],
        F.when(F.col("bear") < 0.10, S.GAPS["bear"]), F.when(F.col("bull") < 0.10, S.GAPS["bull"]),
        F.when(F.col("relevance") < S.LEAST_RELEVANCE, F.format_string("Low query relevance (%.2f) — retrieved nodes may be off-topic", "relevance")),
        F.when(F.col("recency") < S.LEAST_RECENCY, S.GAPS["stale"]),
        F.when(F.col("mean_confidence") < S.LEAST_CONFIDENCE, F.format_string("Low average confidence (%.2f) — need higher credibility sources", "mean_confidence")),
    )
    return a.withColumn("sufficient", F.col("coverage") >= S.SUFFICIENT).withColumn("gaps", F.array_compact(gaps)).select(*group, "n", "diversity", "balance", "relevance", "recency", "mean_confidence", "coverage", "sufficient", "gaps")


def word_relevance(evidence: DataFrame, group: Sequence[str], query_words: Column) -> DataFrame:
    """Mean share of the query's words in each document, where no retrieval scores exist."""
    from ..functions import text as X

    own = X.word_set(F.concat("title", F.lit(" "), "content"))
    return evidence.groupBy(*group).agg(F.round(F.avg(F.when(F.size(own) > 0, X.overlap(query_words, own))), 4).alias("relevance"))


def discarded(evidence: DataFrame, *, score: str = "score") -> DataFrame:
    return evidence.filter(filters.is_discarded(score))


#: Fixed values: (substrings as written, substrings in lower case) of a gap, and what a refined query adds; the first that holds counts.
REFINEMENTS = [
    (("SEC",), ("official",), ["SEC filing", "10-Q", "earnings"]),
    ((), ("bearish", "risk"), ["risk", "downside", "headwind"]),
    ((), ("bullish", "growth"), ["growth", "catalyst", "upside"]),
    ((), ("news",), ["financial news", "analyst report"]),
    ((), ("stale", "recent"), ["latest", "Q3 2024", "recent"]),
]


def refined(query: Column, gaps: Column) -> Column:
    """refined_query() of columns: a query and an array of gaps; a null array is none."""

    def words(gap: Column) -> Column:
        out = F.array().cast("array<string>")
        for exact, low, added in reversed(REFINEMENTS):
            holds = [F.contains(gap, F.lit(w)) for w in exact] + [F.contains(F.lower(gap), F.lit(w)) for w in low]
            out = F.when(reduce(or_, holds), F.array(*[F.lit(w) for w in added])).otherwise(out)
        return out

    found = F.array_distinct(F.flatten(F.transform(F.slice(gaps, 1, 3), words)))
    out = F.trim(F.concat(query, F.lit(" "), F.substring(F.array_join(found, " "), 1, 80)))
    return F.when(F.coalesce(F.size(gaps), F.lit(0)) < 1, query).otherwise(out)


def refined_query(query: str, gaps: Sequence[str]) -> str:
    """The query with words for its first three gaps, at most 80 characters of them."""
    found: list[str] = []
    for gap in gaps[:3]:
        found += next((words for exact, low, words in REFINEMENTS if any(w in gap for w in exact) or any(w in gap.lower() for w in low)), [])
    return f"{query} {' '.join(dict.fromkeys(found))[:80]}".strip() if gaps else query
