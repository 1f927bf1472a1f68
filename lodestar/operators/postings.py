"""Postings of texts, stored by term in blocks of falling impact.

A posting is a document and its impact: what one occurrence of the term in a query adds
to the document's score, but for the query's own factor.  A block knows its greatest
impact, so that a top-k search reads first what promises most and leaves out the blocks
whose documents cannot enter any more.

Texts are read and counted once, within each task; a row of the counts holds thousands of
documents.  What is shuffled are blocks, by term: no exchange has a row for each
document and term.  A common term's postings lie in as many blocks, files and tasks as
they fill.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from .. import tables
from ..functions import text as X

K1, B = 1.5, 0.75
#: Kinds of postings: tokens of the sparse ranking, and tokens of term weights.
RANK, TERM = 0, 1
COUNTS = "kind int, docs long, known long, total long, terms array<string>, ids array<long>, oks array<boolean>, lens array<int>, sizes array<int>, codes array<int>, tfs array<int>, dfs array<int>"
BLOCKS = "kind int, term string, level int, first long, n int, top double, ids array<long>, impacts array<double>, oks array<boolean>"
#: Postings of a block, and texts counted in one row of counts.
BLOCK, DOCUMENTS = 1024, 4096
#: Scores are compared with a bound that is this much lower, for rounding.
MARGIN = 1e-6


@dataclass(frozen=True)
class TextIndex:
    """blocks: (kind, term, n, top, ids, impacts, oks, block); documents: how many; vocabulary: idf by term of the term weights.

    ok says whether a document may be returned; counts are those of all documents.
    """

    blocks: DataFrame
    documents: int
    vocabulary: dict[str, float]

    def of(self, kind: int, terms: Sequence[str] | None = None) -> DataFrame:
        """The blocks of a kind; of some terms only, the scan skips all others."""
        rows = self.blocks.filter(F.col("kind") == kind)
        return rows if terms is None else rows.filter(F.col("term").isin(list(terms)))

    def vocabulary_rows(self, terms: Sequence[str] | None = None) -> DataFrame:
        """(term, idf), of some terms only or of all."""
        wanted = self.vocabulary.keys() if terms is None else self.vocabulary.keys() & set(terms)
        rows = [(t, self.vocabulary[t]) for t in sorted(wanted)]
        return self.blocks.sparkSession.createDataFrame(rows, "term string, idf double")


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Values cut into lists that end at ``ends``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind))


def _one(values, kind: pa.DataType) -> pa.ListArray:
    return _lists(values, np.array([len(values)]), kind)


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])


def count_tokens(texts: pa.Array, drop: frozenset[str], only: frozenset[str] | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, tokens of each text or -1 for a null, distinct terms of each, their codes, their counts, texts of each term).

    Texts are tokens joined by a space.  drop: terms without counts; only: if given, no others
    have any.  Terms stand in order, so that equal texts have equal lists wherever they are.
    """
    words = pc.split_pattern(texts, " ")
    parts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
    lens = np.where(texts.is_null().to_numpy(zero_copy_only=False), -1, np.where(some, parts, 0)).astype(np.int32)
    found = words.flatten().dictionary_encode()
    terms, codes, doc = found.dictionary, found.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(parts)), parts)
    use = ~pc.is_in(terms, pa.array(sorted(drop), terms.type)).to_numpy(zero_copy_only=False)
    if only is not None:
        use &= pc.is_in(terms, pa.array(sorted(only), terms.type)).to_numpy(zero_copy_only=False)
    kept = use[codes] & some[doc]
    codes, doc = codes[kept], doc[kept]
    use[:] = False
    use[codes] = True
    order = pc.array_sort_indices(terms).to_numpy()
    order = order[use[order]]
    place = np.zeros(len(terms), np.int64)
    place[order] = np.arange(len(order))
    n = max(1, len(order))
    pairs = doc * n + place[codes]
    pairs = pairs.astype(np.uint32) if len(parts) * n < 1 << 32 else pairs
    pairs.sort()
    at = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, int)
    tfs = np.diff(np.append(at, len(pairs))).astype(np.int32)
    doc, codes = np.divmod(pairs[at].astype(np.int64), n)
    return terms.take(pa.array(order)), lens, np.bincount(doc, minlength=len(parts)).astype(np.int32), codes.astype(np.int32), tfs, np.bincount(codes, minlength=len(order)).astype(np.int32)


def _counted(kinds: Sequence[int], only: dict[int, frozenset[str]] | None = None):
    """Maps (id, ok, tokens of each kind joined by a space) to COUNTS."""
    stop = frozenset(S.STOPWORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS):
                b = whole.slice(at, DOCUMENTS)
                ids, oks = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                for i, kind in enumerate(kinds):
                    terms, lens, sizes, codes, tfs, dfs = count_tokens(b.column(2 + i), stop if kind == TERM else frozenset(), only[RANK] if only and kind == RANK else None)
                    known = lens[lens >= 0]
                    numbers = [pa.array([n], t) for n, t in ((kind, pa.int32()), (len(lens), pa.int64()), (len(known), pa.int64()), (int(known.sum(dtype=np.int64)), pa.int64()))]
                    lists = [_one(v, t) for v, t in ((terms, pa.string()), (ids, pa.int64()), (oks, pa.bool_()), (lens, pa.int32()), (sizes, pa.int32()), (codes, pa.int32()), (tfs, pa.int32()), (dfs, pa.int32()))]
                    yield _batch([*numbers, *lists], COUNTS)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS to (term, df)."""
    for b in batches:
        for terms, dfs in zip(b.column("terms"), b.column("dfs"), strict=True):
            yield pa.RecordBatch.from_arrays([terms.values, dfs.values.cast(pa.int64())], names=["term", "df"])


def counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, as tokens joined by a space, to (term, df, cf) of some thousand of them."""
    for whole in batches:
        for at in range(0, whole.num_rows, DOCUMENTS):
            terms, _, _, codes, tfs, df = count_tokens(whole.column(0).slice(at, DOCUMENTS), frozenset())
            cf = np.bincount(codes, tfs, len(terms))
            yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), pa.array(df.astype(np.int64)), pa.array(cf.astype(np.int64))], names=["term", "df", "cf"])


def levels(impacts: np.ndarray) -> np.ndarray:
    """Four levels for each halving."""
    return np.floor(4 * np.log2(impacts)).astype(np.int32)


def _posted(avgdl: float, vocabulary: dict[str, float], only: dict[int, frozenset[str]] | None):
    """Maps COUNTS to BLOCKS, a term's postings cut by level unless they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                kind = b.column("kind")[r].as_py()
                terms, ids, oks, lens, sizes, codes, tfs = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("terms", "ids", "oks", "lens", "sizes", "codes", "tfs"))
                doc = np.repeat(np.arange(len(ids)), sizes)
                if kind == RANK:
                    impacts = tfs * (K1 + 1) / (tfs + K1 * (1 - B + B * lens[doc] / avgdl))
                    use = np.ones(len(terms), bool)
                else:
                    idf = np.array([vocabulary.get(t, 0.0) for t in terms])
                    impacts = (1.0 + np.log(tfs)) * idf[codes]
                    length = np.sqrt(np.bincount(doc, impacts * impacts, len(ids)))
                    impacts, use = impacts / np.where(length > 0, length, 1.0)[doc], idf > 0
                if only is not None:
                    use &= np.array([t in only[kind] for t in terms], bool)
                keep = np.flatnonzero(use[codes] & (impacts > 0))
                doc, codes, impacts = doc[keep], codes[keep], impacts[keep]
                level = levels(impacts)
                few = np.bincount(codes, minlength=len(terms)) <= 64
                top = np.full(len(terms), np.iinfo(np.int32).min)
                np.maximum.at(top, codes, level)
                level = np.where(few[codes], top[codes], level)
                order = np.lexsort((-impacts, -level, codes))
                doc, codes, impacts, level = doc[order], codes[order], impacts[order], level[order]
                if not len(codes):
                    continue
                new = np.ones(len(codes), bool)
                new[1:] = (codes[1:] != codes[:-1]) | (level[1:] != level[:-1])
                yield _blocks(np.full(int(new.sum()), kind), pa.array(terms[codes[new]], pa.string()), level[new], np.flatnonzero(new), ids[doc], impacts, oks[doc])

    return run


def _blocks(kind: np.ndarray, term: pa.Array, level: np.ndarray, starts: np.ndarray, ids: np.ndarray, impacts: np.ndarray, oks: np.ndarray) -> pa.RecordBatch:
    """BLOCKS that begin at ``starts`` of the postings, which stand one block after the other."""
    ends = np.append(starts[1:], len(ids))
    numbers = [pa.array(kind, pa.int32()), term, pa.array(level, pa.int32()), pa.array(ids[starts], pa.int64()), pa.array(ends - starts, pa.int32()), pa.array(np.maximum.reduceat(impacts, starts))]
    return _batch([*numbers, _lists(ids, ends, pa.int64()), _lists(impacts, ends, pa.float64()), _lists(oks, ends, pa.bool_())], BLOCKS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins a term's neighbouring blocks, sorted by level, until they hold about BLOCK postings."""
    for b in batches:
        if not b.num_rows:
            continue
        kind, level, n = (b.column(c).to_numpy() for c in ("kind", "level", "n"))
        term = b.column("term").to_numpy(zero_copy_only=False)
        starts = np.cumsum(n) - n
        change = np.ones(len(n), bool)
        change[1:] = (term[1:] != term[:-1]) | (kind[1:] != kind[:-1])
        part = (starts - np.maximum.accumulate(np.where(change, starts, 0))) // BLOCK
        change[1:] |= part[1:] != part[:-1]
        at = np.flatnonzero(change)
        ids, impacts, oks = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "impacts", "oks"))
        yield _blocks(kind[at], pa.array(term[at], pa.string()), level[at], starts[at], ids, impacts, oks)


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a table in fewer parts than the cluster has cores to all of them; others stay as they are.

    So do rows that come from a shuffle: to ask for their parts would run it, and run it again for the rows.
    """
    if re.search(r"\bExchange \w", df._jdf.queryExecution().executedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores else df


@dataclass(frozen=True)
class CountedTexts:
    """Texts read and counted once, of which indexes are made; counts: COUNTS, ``mean``: tokens of a text.

    An index of a few terms costs a pass over the counts, and no shuffle of postings.
    ``only``: terms of the sparse ranking that were counted, None if all were.
    """

    counts: DataFrame
    documents: int
    mean: float
    vocabulary: dict[str, float]
    only: frozenset[str] | None = None

    def has(self, terms: dict[int, frozenset[str]] | None) -> bool:
        """Whether all of these terms were counted, so that they can be indexed."""
        return self.only is None or (terms is not None and terms[RANK] <= self.only)

    def index(self, only: dict[int, frozenset[str]] | None = None) -> TextIndex:
        """Postings of all terms, or of some by kind."""
        blocks = self.counts.mapInArrow(_posted(self.mean, self.vocabulary, only), BLOCKS)
        if only is None:
            order = ["kind", "term", F.desc("level"), "first"]
            blocks = tables.save(blocks).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_merged, BLOCKS)
        blocks = blocks.withColumn("block", F.monotonically_increasing_id())
        return TextIndex(tables.save(blocks, row_group=8 << 20), self.documents, self.vocabulary)


def count(docs: DataFrame, rank: Column, term: Column, *, where: Column | None = None, id_: str = "id", kinds: Sequence[int] = (RANK, TERM), most: int = 4096, only: dict[int, frozenset[str]] | None = None) -> CountedTexts:
    """Reads the documents once.  rank, term: arrays of tokens, stop words still among them.

    most: terms with weights, those that most documents have.  only: terms of the sparse
    ranking that are counted; lengths are those of all terms still.  A document with
    a null text counts, but has no length.  Ids are whole numbers.
    """
    tables.ship_code(docs.sparkSession)
    tables.bound_batches(docs.sparkSession)
    ok = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    tokens = {RANK: rank, TERM: term}
    rows = spread(docs.select(F.col(id_).cast("long").alias("id"), ok.alias("ok"), "title", "content"))
    texts = [F.lower(F.array_join(tokens[k], " ")).alias(f"t{k}") for k in kinds]
    counts = tables.save(rows.select("id", "ok", *texts).mapInArrow(_counted(kinds, only), COUNTS))
    docs_, known, total = counts.filter(F.col("kind") == kinds[0]).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("docs", "known", "total")]).first()
    vocabulary = {}
    if TERM in kinds:
        df = counts.filter(F.col("kind") == TERM).select("terms", "dfs").mapInArrow(_frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        top = df.orderBy(F.desc("df"), "term").limit(most).collect()  # ``most`` rows at most
        vocabulary = {r.term: math.log((1.0 + docs_) / (1.0 + r.df)) + 1.0 for r in top}
    return CountedTexts(counts, docs_, total / known if total else 1.0, vocabulary, only[RANK] if only and RANK in only else None)


def build(docs: DataFrame, rank: Column, term: Column, *, only: dict[int, frozenset[str]] | None = None, **more) -> TextIndex:
    """An index of the documents; ``more`` as in count().  only: terms that get postings, by kind."""
    return count(docs, rank, term, only=only, **more).index(only)


def postings(blocks: DataFrame, *columns: str, restricted: bool = True) -> DataFrame:
    """A row (columns, id, impact) for each posting of the blocks; restricted: of those that may be returned."""
    rows = blocks.select(*columns, F.inline(F.arrays_zip("ids", "impacts", "oks"))).withColumnsRenamed({"ids": "id", "impacts": "impact"})
    return (rows.filter("oks") if restricted else rows).drop("oks")


def summed(blocks: DataFrame, weights: DataFrame, on: str = "term", *, restricted: bool = True) -> DataFrame:
    """(query_id, id, score): weights' w times impact, summed over the blocks."""
    return postings(blocks.join(weights, on), "query_id", "w", restricted=restricted).groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))


def alive(blocks: DataFrame, weights: DataFrame, k: int, *, restricted: bool = True) -> DataFrame:
    """(query_id, block, w): the blocks that may hold one of a query's k best documents.

    weights: (query_id, term, w), w positive.  A document of a block scores at most
    the block's greatest impact and each other term's; the k-th best score is at least
    that of the documents in each term's first blocks, counted from these alone.
    """
    weights, hint = tables.few_or_saved(weights)
    known = blocks.select("term", "block", "top", "n").join(hint(weights), "term").withColumn("bound", F.col("w") * F.col("top"))
    terms, queries = Window.partitionBy("query_id", "term"), Window.partitionBy("query_id")
    order = terms.orderBy(F.desc("bound"), "block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a term's greatest bound counts once, on its first block
    known = known.withColumns({"before": before, "most": F.max("bound").over(terms), "first": F.when(F.row_number().over(order) == 1, F.col("bound")).otherwise(0.0)})
    known = known.withColumn("rest", F.sum("first").over(queries) - F.col("most")).select("query_id", "block", "w", "bound", "before", "rest")
    known, hint = tables.few_or_saved(known)
    seeds = summed(blocks, hint(known.filter(F.col("before") < k).select("query_id", "block", "w")), "block", restricted=restricted)
    place = F.row_number().over(queries.orderBy(F.desc("score")))
    kth = seeds.withColumn("place", place).filter(F.col("place") <= k).filter(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    left = known.join(hint(kth), "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") + F.col("rest") >= F.col("least") - MARGIN))
    return hint(left.select("query_id", "block", "w"))


def best(blocks: DataFrame, weights: DataFrame, k: int, *, restricted: bool = True) -> DataFrame:
    """(query_id, id, score), whole scores of all that may be among the k best; others may be missing or have parts of theirs."""
    return summed(blocks, alive(blocks, weights, k, restricted=restricted), "block", restricted=restricted)
