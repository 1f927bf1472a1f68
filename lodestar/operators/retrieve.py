"""Indexing, retrieval and re-ranking, for many queries at once.

Queries are a table (query_id, query) given by the caller.  A TextIndex holds postings
for both tokenizers, made in one scan of the documents; retrieval reads the blocks of
the queries' terms only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import tables
from ..functions import scores as M
from ..functions import text as X
from ..functions import vectors as V
from . import postings as P
from .postings import RANK, TERM, CountedTexts, TextIndex

RRF_K = 60


def queries(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), "query_id int, query string")


def by_queries(asked: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A broadcast hint for tables that grow with the queries alone, if these are few."""
    return F.broadcast if tables.is_small(asked) else lambda df: df


def rank_tokens() -> Column:
    return X.rank_tokens(F.concat("title", F.lit(" "), "content"))


def term_tokens() -> Column:
    return X.term_tokens(F.concat("title", F.lit(". "), "content"))


def text_index(docs: DataFrame, *, where: Column | None = None, id_: str = "id", kinds: Sequence[int] = (RANK, TERM), most: int = 4096, only: dict[int, frozenset[str]] | None = None) -> TextIndex:
    """Postings of both kinds, from one scan; ``where`` only restricts what is returned."""
    return P.build(docs, *_candidates(), where=where, id_=id_, kinds=kinds, most=most, only=only)


def _candidates() -> tuple[Column, Column]:
    return X.rank_candidates(F.concat("title", F.lit(" "), "content")), X.term_candidates(F.concat("title", F.lit(". "), "content"))


def count_texts(docs: DataFrame, *, where: Column | None = None, id_: str = "id", only: dict[int, frozenset[str]] | None = None) -> CountedTexts:
    """The texts counted by both tokenizers, for indexes of queries that are not known yet: index_of().

    only: terms_of() all queries that may be asked, where that is known; the sparse ranking counts no others.
    """
    return P.count(docs, *_candidates(), where=where, id_=id_, only=only)


def index_of(counted: CountedTexts, asked: DataFrame) -> TextIndex:
    """An index for these queries alone, from texts counted before."""
    return counted.index(terms_of(asked))


def _asked(asked: DataFrame, tokens: Column) -> tuple[DataFrame, list[str] | None, Callable[[DataFrame], DataFrame]]:
    """(query_id, term, times), the distinct terms if they are few, and a hint for what grows with the queries alone."""
    rows = asked.select("query_id", F.explode(tokens).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    terms, hint = tables.few_or_saved(rows)
    return terms, sorted({r.term for r in terms.collect()}) if hint is F.broadcast else None, hint


def text_index_for(docs: DataFrame, asked: DataFrame, *, where: Column | None = None, id_: str = "id") -> TextIndex:
    """An index for these queries alone: if their terms are few, no others get postings."""
    return text_index(docs, where=where, id_=id_, only=terms_of(asked))


def terms_of(asked: DataFrame) -> dict[int, frozenset[str]] | None:
    """The queries' terms by kind, None if they are many."""
    words = [_asked(asked, f(F.col("query")))[1] for f in (X.rank_tokens, X.term_tokens)]
    return None if None in words else {RANK: frozenset(words[0]), TERM: frozenset(words[1])}


def _for_queries(docs: DataFrame | TextIndex, kind: int, terms: list[str] | None, where: Column | None, id_: str, most: int = 4096) -> TextIndex:
    """The index given, or one made of documents for a single use: of few terms, these only get postings."""
    return docs if isinstance(docs, TextIndex) else text_index(docs, where=where, id_=id_, kinds=[kind], most=most, only=None if terms is None else {kind: frozenset(terms)})


def term_statistics(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, df, cf): documents that have each token, and its occurrences, counted within each task before the shuffle.

    Tokens are without spaces.
    """
    tables.ship_code(docs.sparkSession)
    rows = P.spread(docs).select(F.array_join(tokens, " ").alias("tokens")).mapInArrow(P.counted_terms, "term string, df long, cf long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(docs: DataFrame | TextIndex, asked: DataFrame, *, where: Column | None = None, id_: str = "id", restricted: bool = True, k: int | None = None) -> DataFrame:
    """(query_id, id, score): sums over the query's tokens, repeats counted.

    Counts of documents and terms are those of the whole corpus; ``where`` only
    restricts what is returned (``restricted``: for an index, to its ok documents).
    Only blocks of the queries' terms are read.  ``k``: scores are only whole for each
    query's k best, and blocks that cannot hold one are left out.
    """
    terms, words, hint = _asked(asked, X.rank_tokens(F.col("query")))
    index = _for_queries(docs, RANK, words, where, id_)
    blocks = index.of(RANK, words)
    df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    weights = hint(terms).join(df, "term").select("query_id", "term", (F.col("times") * idf(F.col("df"), F.lit(index.documents))).alias("w"))
    if k is None:
        return P.summed(blocks, hint(weights), restricted=restricted)
    return P.best(blocks, weights, k, restricted=restricted)


def ranked(scored: DataFrame, k: int, *, by: str = "score", group: Sequence[str] = ("query_id",), tie: str = "id") -> DataFrame:
    """The k best of each group, with rank from 0; ties go to the smaller id.

    Counted from 1 for the filter, so that no more than k rows of a group leave a partition.
    """
    w = Window.partitionBy(*group).orderBy(F.desc(by), tie)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def by_top(scored: DataFrame, *, by: str = "score", group: Sequence[str] = ("query_id",)) -> DataFrame:
    """Scores over the group's best; a best of 0 or less counts as 1."""
    best = F.max(by).over(Window.partitionBy(*group))
    return scored.withColumn("normalized", F.col(by) / F.when(best > 0, best).otherwise(1.0))


def vocabulary(statistics: DataFrame, n: DataFrame, most: int = 4096) -> DataFrame:
    """(term, idf) of the ``most`` terms that most documents have.  statistics: (term, df); n: one row, n."""
    top = statistics.orderBy(F.desc("df"), "term").limit(most)
    return top.crossJoin(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def term_weights(docs: DataFrame | TextIndex, *, most: int = 4096, id_: str = "id") -> tuple[DataFrame, DataFrame]:
    """(vocab (term, idf), weights (id, term, w)): log-scaled counts times idf, at unit length."""
    index = _for_queries(docs, TERM, None, None, id_, most)
    return index.vocabulary_rows(), P.postings(index.of(TERM), "term", restricted=False).withColumnRenamed("impact", "w")


def term_cosine(docs: DataFrame | TextIndex, asked: DataFrame, *, where: Column | None = None, most: int = 4096, id_: str = "id", k: int | None = None) -> DataFrame:
    """(query_id, id, score): cosine of term weights, the dense side of retrieval for texts.

    Documents without a term of a query do not come out; ``k`` as in bm25().
    """
    terms, words, hint = _asked(asked, X.term_tokens(F.col("query")))
    index = _for_queries(docs, TERM, words, where, id_, most)
    # no more rows than ``most``
    q = terms.join(F.broadcast(index.vocabulary_rows(words)), "term").withColumn("raw", (1.0 + F.log("times")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("query_id")))
    weights = q.select("query_id", "term", (F.col("raw") / length).alias("w"))
    blocks = index.of(TERM, words)
    if k is None:
        return P.summed(blocks, hint(weights))
    return P.best(blocks, weights, k)


def fuse(lists: Sequence[tuple[DataFrame, float]], k: int, *, constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists, the k best and their score over the best one's."""
    rows = None
    for ranked_, weight in lists:
        own = ranked_.select("query_id", "id", (F.lit(float(weight)) / (constant + F.col("rank") + 1)).alias("part"))
        rows = own if rows is None else rows.unionByName(own)
    return by_top(ranked(rows.groupBy("query_id", "id").agg(F.sum("part").alias("score")), k))


def hybrid(docs: DataFrame | TextIndex, asked: DataFrame, k: int = 25, *, where: Column | None = None, weights: tuple[float, float] = (0.5, 0.5), filter_sparse: bool = True) -> DataFrame:
    """Dense and sparse lists of 2k each, fused: (query_id, id, score, rank, normalized)."""
    index = docs if isinstance(docs, TextIndex) else text_index_for(docs, asked, where=where)
    dense = ranked(term_cosine(index, asked, k=2 * k), 2 * k)
    sparse = ranked(bm25(index, asked, restricted=filter_sparse, k=2 * k), 2 * k)
    return fuse([(dense, weights[0]), (sparse, weights[1])], k)


def rerank(candidates: DataFrame, docs: DataFrame, asked: DataFrame, n: int = 15, *, previous: str | None = None) -> DataFrame:
    """Candidates scored against the query's words, the n best: (query_id, id, rerank_score, place).

    Candidates are short lists, some for each query.  Ties keep their order.  ``previous``
    names a column with the score of an earlier round.  The ids of few candidates go
    into the scan, so that other texts meet no join.
    """
    hint = by_queries(asked)
    candidates, near = tables.few_or_saved(candidates)
    if near is F.broadcast:
        docs = docs.filter(F.col("id").isin([r["id"] for r in candidates.select("id").distinct().collect()]))
    q = hint(asked.select("query_id", "query", X.word_set(F.col("query")).alias("words")))
    rows = docs.join(hint(candidates), "id").join(q, "query_id")
    score = M.cross_score(F.col("query"), F.col("words"), F.col("title"), F.col("content"), F.col("credibility"), F.col("confidence"), F.col(previous) if previous else F.lit(None).cast("double"))
    rows = rows.withColumn("rerank_score", score)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank", "id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("query_id", "id", "rerank_score", (F.col("place") - 1).alias("place"))


#: Vectors of one block, about, and queries whose products with them a task holds at a time.
ROWS, AT_ONCE = 16384, 256


def _unit_matrix(t: pa.Table, column: str) -> np.ndarray:
    """The table's vectors, all of one length; a missing number counts as NaN."""
    values = t[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values, float).reshape(len(t), len(values) // max(1, len(t)))


def _first_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of equal rows, in order; of copies no others can be among a query's k nearest."""
    _, copy = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True) if x.shape[1] else (None, np.zeros(len(x), int))
    order = np.argsort(copy, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = copy[order][1:] != copy[order][:-1]
    at = np.arange(len(order))
    return np.sort(order[at - np.maximum.accumulate(np.where(first, at, 0)) < k])


def _distances(x: np.ndarray, u: np.ndarray, q: np.ndarray, r: np.ndarray, slice_: int = 1 << 16) -> np.ndarray:
    """1 - u.x of the pairs (q, r), summed from the first number to the last, so that copies are equally far."""
    out = np.empty(len(q))
    for a in range(0, len(q), slice_):
        v, w = x[r[a : a + slice_]], u[q[a : a + slice_]]
        total = np.zeros(len(v))
        for j in range(x.shape[1]):
            total += v[:, j] * w[:, j]
        out[a : a + slice_] = 1 - total
    return out


def _nearest_in_block(k: int):
    """Each query's k nearest rows of a block: those that a matrix product cannot rule out are compared exactly."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        x, u, found = _unit_matrix(rows, "v"), _unit_matrix(asked, "u"), []
        kept = _first_copies(x, k)
        x = x[kept]
        for a in range(0, len(u), AT_ONCE) if len(x) else ():
            with np.errstate(all="ignore"):
                near = u[a : a + AT_ONCE] @ x.T
            near[np.isnan(near)] = -np.inf
            least = np.partition(near, len(x) - k, 1)[:, len(x) - k] if len(x) > k else np.full(len(near), -np.inf)
            q, r = np.nonzero(near >= (least - 1e-9)[:, None])
            d = _distances(x, u, q + a, r)
            order = np.lexsort((r, d, q))
            q, r, d = q[order], r[order], d[order]
            first = np.ones(len(q), bool)
            first[1:] = q[1:] != q[:-1]
            at = np.arange(len(q))
            best = at - np.maximum.accumulate(np.where(first, at, 0)) < k
            found.append((q[best] + a, r[best], d[best]))
        q, r, d = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": asked["query_id"].take(pa.array(q)), "id": rows["id"].take(pa.array(kept[r])), "distance": pa.array(d)})

    return run


def nearest_by_block(rows: DataFrame, asked: DataFrame, k: int, *on: str) -> DataFrame:
    """(query_id, id, distance, similarity, rank): rows (on, id, v) meet the queries (on, query_id, u) that are alike in ``on``.

    v and u have length 1 or are zeros; those of different sizes do not meet.  A group may be
    no larger than a task can hold.  No more than k rows for each query leave a group.
    """
    tables.ship_code(rows.sparkSession)
    keys = ["__size", *on]
    a = rows.filter("v IS NOT NULL AND id IS NOT NULL").withColumn("__size", F.size("v")).groupBy(*keys)
    b = asked.filter("u IS NOT NULL").withColumn("__size", F.size("u")).groupBy(*keys)
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, distance double"
    found = a.cogroup(b).applyInArrow(_nearest_in_block(k), kinds)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
    return found.withColumn("similarity", V.similarity(F.col("distance"))).select("query_id", "id", "distance", "similarity", "rank")


def nearest_units(unit: DataFrame, q: DataFrame, k: int, *, block: int = 2000) -> DataFrame:
    """nearest() of vectors (id, v) and queries (query_id, u) that have length 1 or are zeros."""
    parts, blocks = (max(1, -(-df.count() // size)) for df, size in ((unit, ROWS), (q, block)))

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n).cast("long"))).withColumn(other, every)

    rows = dealt(unit.select("id", "v"), "id", "part", parts, "block", blocks)
    asked = dealt(q.select("query_id", "u"), "query_id", "block", blocks, "part", parts)
    return nearest_by_block(rows, asked, k, "part", "block")


def nearest(vectors: DataFrame, asked: DataFrame, k: int, *, id_: str = "vec_id", vector: str = "embedding", block: int = 2000) -> DataFrame:
    """Exact nearest vectors by cosine distance: (query_id, id, distance, similarity, rank).

    ``asked``: (query_id, q).  Vectors, and queries by about ``block``, are dealt into blocks;
    each of either meets each of the other, and only k rows for each query leave such a pair.
    """
    unit = vectors.select(F.col(id_).alias("id"), V.normalize(F.col(vector)).alias("v"))
    return nearest_units(unit, asked.select("query_id", V.normalize(F.col("q")).alias("u")), k, block=block)


def expand(asked: DataFrame, *, ticker: str = "ticker") -> DataFrame:
    """Each query, and two rewordings of it with the ticker in front."""
    t = F.upper(ticker)
    forms = F.array("query", F.concat(t, F.lit(" "), "query", F.lit(" SEC 10-K quarterly earnings balance sheet valuation")), F.concat(t, F.lit(" "), "query", F.lit(" risk factors competition margin headwinds")))
    return asked.select("query_id", F.posexplode(forms).alias("form", "query"))


def materialize(ids: DataFrame, docs: DataFrame, *, array: str = "ids") -> DataFrame:
    """Documents of an ordered array of ids, in that order; unknown ids are left out."""
    return ids.select(F.posexplode(array).alias("pos", "id")).join(docs, "id").orderBy("pos")
