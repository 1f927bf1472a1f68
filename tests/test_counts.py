"""Counted texts: the counts themselves, and which words the loop counts."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.operators import postings as P
from lodestar.operators import retrieve
from lodestar.plans import loop, planner

RNG = random.Random(1)
MANY = [" ".join(RNG.choices([f"w{i}" for i in range(500)], k=RNG.randint(0, 50))) for _ in range(3000)]


@pytest.mark.parametrize("texts", [[], [None], [""], ["a b a", "é a", None, "", "b b"], MANY])
@pytest.mark.parametrize("drop, only", [((), None), (("a", "w1"), None), ((), ("b", "w2", "z")), ((), ())])
def test_counts_are_those_of_a_plain_count(texts, drop, only):
    terms, lens, sizes, codes, tfs, dfs = P.count_tokens(pa.array(["left out", *texts], pa.string()).slice(1), frozenset(drop), None if only is None else frozenset(only))
    terms, at, df = terms.to_pylist(), 0, Counter()
    for s, n, size in zip(texts, lens, sizes, strict=True):
        words = s.split(" ") if s else []
        want = Counter(w for w in words if w not in drop and (only is None or w in only))
        assert n == (-1 if s is None else len(words)) and size == len(want)
        assert {terms[c]: t for c, t in zip(codes[at : at + size], tfs[at : at + size], strict=True)} == want
        df.update(want.keys())
        at += size
    assert at == len(codes) == len(tfs) and dict(zip(terms, dfs.tolist(), strict=True)) == df


def test_loop_counts_words_that_may_be_asked(spark, monkeypatch):
    """Others only once a query has one, as none of the rules' but a cut one can."""
    rows = [(i, f"common w{i % 50} revenue", "S1") for i in range(200)]
    docs = spark.createDataFrame(rows, "id long, content string, ticker string").withColumns({"title": F.lit("t"), "source_type": F.lit("other"), "credibility": F.lit("high"), "confidence": F.lit(0.5), "sentiment": F.lit("neutral"), "published": F.lit("2024-01-01").cast("timestamp_ntz")})
    as_of, made, count = F.lit("2024-01-31").cast("timestamp_ntz"), [], retrieve.count_texts
    monkeypatch.setattr(retrieve, "count_texts", lambda *a, **k: made.append(count(*a, **k)) or made[-1])
    loop.run(docs, "common w25", "s1", as_of)
    ranked = {t for r in made[0].counts.filter(F.col("kind") == P.RANK).select("terms").collect() for t in r.terms}
    assert len(made) == 1 and ranked == {"common", "w25", "revenue"}
    made.clear()
    monkeypatch.setattr(planner, "rewrite", lambda *a: "common w7")
    found = loop.run(docs, "common w25", "s1", as_of, rounds=2)
    assert len(made) == 2 and {i for i in found.ids if i % 50 == 7}
