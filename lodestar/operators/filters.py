"""Predicates on evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def metadata_filter(ticker: str | None = None, sources: Sequence[str] = (), since=None, until=None, tags: Sequence[str] = ()) -> Column:
    """All that is given must hold; bounds are inclusive, one common tag is enough."""
    out = F.lit(True)
    if ticker:
        out &= F.upper("ticker") == ticker.upper()
    if sources:
        out &= F.col("source_type").isin(list(sources))
    if since is not None:
        out &= F.col("published") >= F.lit(since)
    if until is not None:
        out &= F.col("published") <= F.lit(until)
    if tags:
        out &= F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))
    return out


def as_of(df: DataFrame, cutoff: Column | None, column: str = "published") -> DataFrame:
    """Rows known at the cutoff; all without one."""
    return df if cutoff is None else df.filter(F.col(column) <= cutoff)


def parse_date(text: Column) -> Column:
    """Midnight of a year-month-day text; null if it is none."""
    return F.try_to_timestamp(text, F.lit("yyyy-M-d"))


def is_bullish(sentiment: str = "sentiment") -> Column:
    return F.col(sentiment).isin(S.BULLISH)


def is_bearish(sentiment: str = "sentiment") -> Column:
    return F.col(sentiment).isin(S.BEARISH)


def is_discarded(score: str = "score") -> Column:
    """Badly matched, of low credibility and low confidence; an unknown score counts as 1."""
    return (F.coalesce(F.col(score), F.lit(1.0)) < 0.15) & (F.col("credibility") == "low") & (F.col("confidence") < 0.5)


def browse(text: str = "", ticker: str = "", source_type: str = "", credibility: str = "", least: float = 0.0) -> Column:
    """What a reader types: a substring of any field, exact choices, a least confidence."""
    out = F.col("confidence") >= least
    if text:
        out &= F.greatest(*[F.contains(F.lower(c), F.lit(text.lower())) for c in ("title", "content", "ticker", "source_type")])
    for c, v in (("ticker", ticker), ("source_type", source_type), ("credibility", credibility)):
        if v:
            out &= F.col(c) == v
    return out


def embedding_text(length: int) -> Column:
    return F.concat("title", F.lit(". "), F.substring("content", 1, length))
