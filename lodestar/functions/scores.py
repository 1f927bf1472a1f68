"""Score formulas as column expressions.

Ratios that count 0 as missing say so: null and 0 both fall back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from . import text as X


def lookup(column: Column, table: dict[str, float], default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(default)


def or_default(x: Column, default) -> Column:
    """Null and 0 count as missing."""
    return F.coalesce(F.nullif(x, F.lit(0)), default if isinstance(default, Column) else F.lit(default))


def ratio(a: Column, b: Column) -> Column:
    """a / b of numbers, with 0 as a divisor as in IEEE 754: infinite, or NaN for 0 / 0; null of nulls only."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def nearest_places(x: Column, places: int) -> Column:
    """Rounded as in DuckDB: the double times 10^places to the nearest whole number, halves away from 0.

    F.round goes by the shortest decimal text instead, where a product just below a half counts as one.
    """
    return F.round(x * 10.0**places) / 10.0**places


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def days_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86400e6)


def decay(days: Column, rate: float) -> Column:
    return F.exp(-rate * F.greatest(days, F.lit(0.0)))


def context_score(credibility: Column, confidence: Column, days: Column, relevance: Column, rag: Column) -> Column:
    """Rank of an item for the context: trust x confidence x freshness x relevance x (1 + 0.3 retrieval score)."""
    return lookup(credibility, S.CREDIBILITY_WEIGHT, 1.0) * confidence * decay(days, 0.05) * (1 + relevance) * (1 + 0.3 * or_default(rag, 0.5))


def cross_score(query: Column, query_words: Column, title: Column, content: Column, credibility: Column, confidence: Column, previous: Column) -> Column:
    """Re-ranking score of a document for a query, from 0 to 1."""
    doc = F.concat(F.lower(title), F.lit(" "), F.lower(content))
    coverage = X.overlap(query_words, X.word_set(doc))
    phrase = F.when(X.is_phrase(query) & F.contains(doc, F.lower(query)), 1.4).otherwise(1.0)
    trust = F.least(F.lit(1.0), lookup(credibility, S.CREDIBILITY_WEIGHT, 1.0) / 1.5)
    raw = (coverage * 0.40 + or_default(previous, 0.5) * 0.30 + trust * 0.20 + clamp(confidence, 0.2) * 0.10) * phrase
    return F.round(clamp(raw), 4)


def guarded(numerator: Column, denominator: Column, default: float, factor: float = 1.0) -> Column:
    """factor x numerator / denominator, to two places, where the denominator is above 0."""
    return F.when(denominator > 0, F.round(numerator / denominator * factor, 2)).otherwise(F.lit(default))


def direction_correct(rating: Column, change: Column) -> Column:
    return F.when(rating.isin("BUY", "STRONG_BUY"), change > 0).when(rating.isin("SELL", "STRONG_SELL"), change < 0).otherwise(F.abs(change) <= 5.0)


def strength_ratio(bull: Column, bear: Column) -> Column:
    return F.when((bull == 0) & (bear == 0), 1.0).when(bear == 0, 3.0).otherwise(F.round(F.try_divide(bull, bear), 2))


def rating(ratio: Column) -> Column:
    return (
        F.when(ratio >= 3.0, "STRONG_BUY").when(ratio >= 2.0, "BUY").when(ratio <= 0.3, "STRONG_SELL").when(ratio <= 0.5, "SELL").otherwise("HOLD")
    )


def conviction(ratio: Column) -> Column:
    strong = F.least(F.lit(0.95), F.round(0.6 + ratio * 0.1, 2))
    weak = F.least(F.lit(0.95), F.round(0.6 + (1.0 / F.greatest(ratio, F.lit(0.01))) * 0.1, 2))
    return F.when(ratio >= 2.0, strong).when(ratio <= 0.5, weak).otherwise(F.lit(0.60))
