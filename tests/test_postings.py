"""Posting blocks: what they hold, what a search leaves out, and that nothing is lost by it."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.operators import postings as P
from lodestar.operators import retrieve

SCHEMA = "id long, title string, content string, ticker string"


@pytest.fixture(scope="module")
def corpus(spark):
    """A common word everywhere, others ever rarer; some documents without text."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, "t", "common " + " ".join(rng.choices(words, [1 / (j + 1) for j in range(300)], k=rng.randint(1, 60))), f"S{i % 3}") for i in range(6000)]
    rows += [(6000, None, "common", "S0"), (6001, "t", None, "S0"), (6002, "", "", "S0")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def plain_bm25(rows, query):
    texts = {r.id: None if r.title is None or r.content is None else f"{r.title} {r.content}".split() for r in rows}
    # tokens are of two characters or more
    texts = {i: None if t is None else [w for w in t if len(w) > 1] for i, t in texts.items()}
    lens = [len(t) for t in texts.values() if t is not None]
    avgdl, n, out = sum(lens) / len(lens), len(texts), Counter()
    for w, times in Counter(query.split()).items():
        hits = {i: t.count(w) for i, t in texts.items() if t and w in t}
        idf = math.log((n - len(hits) + 0.5) / (len(hits) + 0.5) + 1)
        for i, tf in hits.items():
            out[i] += times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(texts[i]) / avgdl))
    return out


@pytest.fixture(scope="module")
def index(corpus):
    return retrieve.text_index(corpus, where=F.col("ticker") != "S1")


def test_blocks_hold_what_they_say(index):
    blocks = index.blocks.collect()
    by_term = {}
    for b in blocks:
        assert b.n == len(b.ids) == len(b.impacts) == len(b.oks) and b.top == max(b.impacts) and b.n < 2 * P.BLOCK
        by_term.setdefault((b.kind, b.term), []).append(b)
    assert len({b.block for b in blocks}) == len(blocks) and index.documents == 6003
    common = by_term[P.RANK, "common"]
    assert sum(b.n for b in common) == 6000 and len(common) >= 6000 / (2 * P.BLOCK)
    # by level, blocks fall: the least of one is not far below the greatest of the next
    falling = sorted(common, key=lambda b: -b.top)
    assert all(min(a.impacts) * 2 ** 0.26 >= b.top for a, b in zip(falling, falling[1:], strict=False))
    lengths = Counter()
    for (kind, _), bs in by_term.items():
        for b in bs if kind == P.TERM else []:
            lengths.update({i: w * w for i, w in zip(b.ids, b.impacts, strict=True)})
    assert all(abs(x - 1) < 1e-9 for x in lengths.values())


@pytest.mark.parametrize("k", [1, 10, 50, 100_000])
def test_best_are_those_of_all(spark, corpus, index, k):
    rows = corpus.collect()
    asked = retrieve.queries(spark, [(1, "common w250 w251"), (2, "common"), (3, "w0 w0 w1 common w299"), (4, "nothing known"), (5, "")])
    for restricted in (True, False):
        got = retrieve.ranked(retrieve.bm25(index, asked, k=k, restricted=restricted).withColumn("score", F.round("score", 9)), k).collect()
        for i, query in ((1, "common w250 w251"), (2, "common"), (3, "w0 w0 w1 common w299")):
            ok = {r.id for r in rows if not restricted or r.ticker != "S1"}
            want = sorted(((-round(s, 9), j) for j, s in plain_bm25(rows, query).items() if j in ok))[:k]
            mine = sorted((-r.score, r.id) for r in got if r.query_id == i)
            assert [j for _, j in mine] == [j for _, j in want] and all(abs(a - b) < 1e-8 for (a, _), (b, _) in zip(mine, want, strict=True))
        assert {r.query_id for r in got} == {1, 2, 3}
    full = {(r.query_id, r.id): r.score for r in retrieve.term_cosine(index, asked).collect()}
    some = retrieve.ranked(retrieve.term_cosine(index, asked, k=k).withColumn("score", F.round("score", 9)), k).collect()
    for i in (1, 2, 3):
        want = sorted(((-round(s, 9), j) for (q, j), s in full.items() if q == i))[:k]
        assert [j for _, j in want] == [j for _, j in sorted((-r.score, r.id) for r in some if r.query_id == i)]


def test_blocks_that_cannot_enter_are_left_out(spark, index):
    for terms, share in (({"common": 1.0}, 0.5), ({"common": 0.1, "w0": 2.0}, 0.7)):
        blocks = index.of(P.RANK, list(terms))
        weights = spark.createDataFrame([(1, t, w) for t, w in terms.items()], "query_id int, term string, w double")
        left = P.alive(blocks, weights, 5).count()
        assert 0 < left <= share * blocks.count()
    # a document without the rare word scores less than one with it, but one with both may be in any block
    blocks = index.of(P.RANK, ["common", "w250"])
    weights = spark.createDataFrame([(1, "common", 1e-4), (1, "w250", 5.0)], "query_id int, term string, w double")
    assert P.alive(blocks, weights, 5).count() > 1


def test_single_use_index_has_the_queries_terms_only(spark, corpus, index):
    asked = retrieve.queries(spark, [(1, "common w250"), (2, "w0")])
    small = retrieve.text_index_for(corpus, asked, where=F.col("ticker") != "S1")
    assert {r.term for r in small.blocks.collect()} == {"common", "w250", "w0"} and small.vocabulary == index.vocabulary
    for f in (retrieve.bm25, retrieve.term_cosine):
        rows = lambda ix, f=f: sorted((r.query_id, r.id, round(r.score, 9)) for r in f(ix, asked).collect())
        assert rows(small) == rows(index)
    a, b = (sorted((r.query_id, r.id, round(r.normalized, 9)) for r in retrieve.hybrid(x, asked, 7, where=F.col("ticker") != "S1").collect()) for x in (corpus, index))
    assert a == b


def test_loop_indexes_a_rounds_terms_only(spark, corpus, index, monkeypatch):
    from lodestar.plans import loop

    seen, hybrid = [], retrieve.hybrid
    monkeypatch.setattr(retrieve, "hybrid", lambda ix, asked, k: seen.append((ix, asked)) or hybrid(ix, asked, k))
    docs = corpus.filter("id < 300").withColumns({"source_type": F.lit("other"), "credibility": F.lit("high"), "confidence": F.lit(0.5), "sentiment": F.lit("neutral"), "published": F.lit("2024-01-01").cast("timestamp_ntz")})
    found = loop.run(docs, "common w250", "s1", F.lit("2024-01-31").cast("timestamp_ntz"))
    assert len(seen) == len(found.rounds) and found.ids
    for ix, asked in seen:
        words = set(asked.first().query.lower().replace(".", " ").split())
        assert {r.term for r in ix.blocks.collect()} <= words
    counted = retrieve.count_texts(corpus, where=F.col("ticker") != "S1")
    asked = retrieve.queries(spark, [(1, "common w250"), (2, "w0")])
    a, b = (sorted((r.query_id, r.id, round(r.normalized, 9)) for r in hybrid(x, asked, 7).collect()) for x in (retrieve.index_of(counted, asked), index))
    assert a == b


def test_no_documents(spark):
    empty, asked = spark.createDataFrame([], SCHEMA), retrieve.queries(spark, [(1, "common")])
    index = retrieve.text_index(empty)
    assert (index.documents, index.vocabulary, retrieve.hybrid(index, asked).collect()) == (0, {}, [])
    assert retrieve.bm25(empty, asked, k=3).collect() == retrieve.term_cosine(empty, asked).collect() == []
