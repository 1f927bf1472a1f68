"""Research plans: sector, horizon, sources and focus, by rules on ticker and query; query rewriting."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X


def plan(asked: DataFrame) -> DataFrame:
    """One plan for each (ticker, query) row."""
    rows = asked.withColumn("ticker", F.upper(F.trim("ticker"))).withColumn("sector", X.sector(F.col("ticker"), F.col("query"))).withColumn("horizon", X.horizon(F.col("query")))

    def pick(place: int) -> Column:
        out = F.array().cast("array<string>")
        for name, parts in S.SECTORS.items():
            out = F.when(F.col("sector") == name, F.array(*[F.lit(x) for x in parts[place]]).cast("array<string>")).otherwise(out)
        return out

    base = F.array(*[F.lit(a) for a in S.ADAPTERS])
    return rows.withColumn("teams", F.array(*[F.lit(t) for t in S.TEAMS])).withColumn("adapters", F.array_sort(F.array_distinct(F.concat(base, pick(2))))).withColumn("focus", pick(3))


def rewritten(query: Column, gaps: Column, iteration: Column, ticker: Column) -> Column:
    """The query for the next round, for the gaps found in round ``iteration``.

    Round 1 keeps the query, as does one without gaps.  Of each of the first three gaps the
    first key that it contains adds its terms: as they are after round 2, as new words later.
    """

    def terms(gap: Column) -> Column:
        out = F.lit(None).cast("string")
        for key, words in reversed(S.ASPECT_TERMS.items()):
            out = F.when(F.contains(F.lower(gap), F.lit(key)), words).otherwise(out)
        return out

    found = F.array_compact(F.transform(F.slice(gaps, 1, 3), terms))
    start = F.when(F.coalesce(ticker, F.lit("")) != "", F.concat(F.upper(ticker), F.lit(" "))).otherwise("")
    new = F.array_except(X.word_set(F.array_join(found, " ")), X.word_set(query))
    plain = F.concat(start, query, F.lit(f" {S.LAST_RESORT}"))
    second = F.concat(start, query, F.lit(" "), F.array_join(F.slice(found, 1, 2), " "))
    later = F.concat(start, query, F.lit(" "), F.array_join(F.slice(new, 1, 12), " "), F.lit(" fundamental analysis"))
    out = F.when(F.size(found) == 0, plain).when(iteration == 2, second).otherwise(later)
    kept = (F.coalesce(F.size(gaps), F.lit(0)) < 1) | (iteration <= 1)
    return F.when(kept, query).otherwise(F.substring(F.regexp_replace(out, X.EDGES, ""), 1, 250))


def words_of_rewrites(query: str, ticker: str = "") -> str:
    """A text with all words that rewritten() may use, but for one cut at the end of a long query."""
    terms = " ".join([*S.ASPECT_TERMS.values(), S.LAST_RESORT])
    return " ".join([ticker.upper(), query, terms, *re.findall(r"\w+", terms.lower()), "fundamental analysis"])


def rewrite(spark: SparkSession, query: str, gaps: Sequence[str], iteration: int, ticker: str = "", provider: Callable[[str], str] | None = None) -> str:
    """rewritten() for one question; a provider, if given, is asked first, for a line of more than eight characters."""
    if provider and gaps and iteration > 1:
        listed = "\n".join(f"- {g}" for g in gaps[:4])
        try:
            answer = provider(f"Question: {query}\nTicker: {ticker.upper() or 'none'}\nEvidence is missing:\n{listed}\nGive one search query of at most 30 words that would find it, and nothing else.")
        except Exception:  # whatever a remote service throws, the rules answer
            answer = ""
        line = answer.strip().split("\n")[0].strip("\"'")
        if len(answer.strip()) > 8 and line:
            return line
    row = spark.createDataFrame([(query, list(gaps), iteration, ticker)], "q string, g array<string>, i int, t string")
    return row.select(rewritten(F.col("q"), F.col("g"), F.col("i"), F.col("t"))).first()[0]
