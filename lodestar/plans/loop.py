"""The agentic retrieval loop: retrieve, re-rank, criticise, rewrite, until the evidence is enough.

The driver holds only the query, at most fifteen scored ids for each round, and the
critic's one row; documents stay distributed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import critic, retrieve
from . import planner


@dataclass
class Research:
    """What the loop found."""

    ticker: str
    query: str
    final_query: str
    coverage: float = 0.0
    converged: bool = False
    curated: list[tuple[int, float]] = field(default_factory=list)
    discarded: list[int] = field(default_factory=list)
    rounds: list[dict] = field(default_factory=list)

    @property
    def ids(self) -> list[int]:
        return [i for i, _ in self.curated]


def run(docs: DataFrame, query: str, ticker: str, as_of: Column, *, rounds: int = 3, k: int = 25, n: int = 15, provider: Callable[[str], str] | None = None) -> Research:
    """Runs the loop for one question over ``docs``.

    A round's scores enter the next one's re-ranking; a document keeps its best
    score; one discarded in any round is not curated.  The ticker only restricts a
    corpus of more than ten documents.
    """
    spark, ticker = docs.sparkSession, ticker.upper().strip()
    out, current = Research(ticker, query, query), query
    size = docs.limit(11).count()
    if not size:
        return out
    where = F.upper("ticker") == ticker if size > 10 else None
    # once for all rounds, of the words that the rules may ask for
    possible = None if provider else retrieve.terms_of(retrieve.queries(spark, [(1, planner.words_of_rewrites(query, ticker))]))
    counted = retrieve.count_texts(docs, where=where, only=possible)
    best: dict[int, float] = {}
    last: dict[int, float] = {}
    gone: set[int] = set()
    for i in range(1, rounds + 1):
        asked = retrieve.queries(spark, [(1, current)])
        terms = retrieve.terms_of(asked)
        if not counted.has(terms):
            counted = retrieve.count_texts(docs, where=where)
        found = retrieve.hybrid(counted.index(terms), asked, k)
        if last:
            previous = spark.createDataFrame(list(last.items()), "id long, previous double")
            found = found.join(F.broadcast(previous), "id", "left")
        scored = retrieve.rerank(found, docs, asked, n, previous="previous" if last else None)
        rows = scored.orderBy("place").collect()  # n rows at most
        retrieved = len(rows)
        scores = {r["id"]: r["rerank_score"] for r in rows}
        last |= scores
        for x, s in scores.items():
            best[x] = max(best.get(x, 0.0), s)
        kept = spark.createDataFrame(list(scores.items()) or [], "id long, score double").withColumn("query_id", F.lit(1)) if scores else None
        if kept is None:
            review = {"coverage": 0.0, "sufficient": False, "gaps": []}
        else:
            evidence = docs.join(F.broadcast(kept), "id")
            review = critic.coverage(evidence, ["query_id"], as_of).first().asDict()
            gone |= {r["id"] for r in critic.discarded(evidence).select("id").collect()}
        out.coverage, out.final_query = review["coverage"], current
        out.rounds.append({"iteration": i, "query": current, "retrieved": retrieved, "coverage": review["coverage"], "sufficient": review["sufficient"], "gaps": review["gaps"]})
        if review["sufficient"]:
            out.converged = True
            break
        if i < rounds:
            current = planner.rewrite(spark, query, review["gaps"], i, ticker, provider)
    out.discarded = sorted(gone)
    out.curated = sorted(((x, s) for x, s in best.items() if x not in gone), key=lambda x: -x[1])
    return out
