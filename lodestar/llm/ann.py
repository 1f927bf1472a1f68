"""Approximate nearest neighbours by cross-polytope hashing.

A table turns vectors by a fast pseudo-random rotation, three rounds of random signs
and a Hadamard transform, and files each under its nearest signed axis.  With many
vectors a second, shorter rotation splits the buckets further.  A query looks into
the buckets of its best few axes in every table, more of them the more buckets there
are; what it finds in any table is compared once, and the nearest are ranked by their
exact cosines.  A query that finds too few is compared with all rows.

Vectors lie in blocks, each with its own tables, and are moved once; a block gets all
queries.  The bytes so moved are few beside the comparisons they serve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytescan as B
from . import vectors as V
from .scratch import Scratch, small_batches


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(maxsize=64)
def _signs(width: int, table: int, part: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([table, part, width])).choice([-1.0, 1.0], (3, width))


def rotated(x: np.ndarray, table: int, part: int) -> np.ndarray:
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for s in _signs(width, table, part):
        y = hadamard(y * s)
    return y


def axes(y: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """(signed axes, how near) of each row, nearest first."""
    signed = np.concatenate([y, -y], 1)
    order = np.argsort(-signed, 1, kind="stable")[:, :best]
    return order, np.take_along_axis(signed, order, 1)


def buckets(x: np.ndarray, table: int, fine: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest buckets of each unit vector in a table; fine: axes of the second rotation, or 0."""
    a, near = axes(rotated(x, table, 0), probes)
    if not fine:
        return a
    b, close = axes(rotated(x, table, 1)[:, :fine], min(probes, 2 * fine))
    score = (near[:, :, None] + close[:, None, :]).reshape(len(x), -1)
    both = (a[:, :, None] * 2 * fine + b[:, None, :]).reshape(len(x), -1)
    return np.take_along_axis(both, np.argsort(-score, 1, kind="stable")[:, :probes], 1)


def second_axes(n: int, length: int, bucket_rows: int) -> int:
    """Axes of the second rotation for n vectors of a length."""
    width, fine = 1 << max(0, length - 1).bit_length(), 0
    while 2 * width * max(1, 2 * fine) * bucket_rows < n and fine < width:
        fine = max(1, 2 * fine)
    return fine


class Tables:
    """The tables of a block of unit vectors, ``n`` being the number of all."""

    def __init__(self, rows: np.ndarray, n: int, tables: int, probes: int, bucket_rows: int):
        self.fine, self.size = second_axes(n, rows.shape[1], bucket_rows), len(rows)
        self.probes = math.ceil(probes * math.sqrt(2 * self.fine)) if self.fine else probes
        self.tables = []
        for t in range(tables):
            own = np.concatenate([buckets(rows[i : i + 4096], t, self.fine, 1)[:, 0] for i in range(0, len(rows), 4096)])
            order = np.argsort(own, kind="stable")
            self.tables.append((own[order], order))

    def candidates(self, asked: np.ndarray) -> np.ndarray:
        """Which rows (second axis) each query meets in some table."""
        out = np.zeros((len(asked), self.size), bool)
        for t, (own, order) in enumerate(self.tables):
            found = buckets(asked, t, self.fine, self.probes)
            lo, hi = (np.searchsorted(own, found, side) for side in ("left", "right"))
            counts = (hi - lo).ravel()
            out[np.repeat(np.repeat(np.arange(len(asked)), found.shape[1]), counts), order[np.repeat(lo.ravel(), counts) + B.runs_in(counts)]] = True
        return out


def search(
    df: DataFrame, queries: Column, *, id_: str = "vec_id", vector: str = "embedding", k: int = 5, tables: int = 16, probes: int | None = 8,
    bucket_rows: int = 500, block: int = 65536, least_blocks: int = 12, scratch: Scratch | None = None,
) -> DataFrame:
    """The k nearest found to each row of ``df`` for which ``queries`` holds: query_id, rank, vec_id, score.

    score is the cosine of the original vectors in double precision; rank 1 is the
    nearest, ties go to the smaller id.  Rows with the query's own id are no candidates; of rows with one id the
    nearest counts, and queries with one id are one query, whose vectors all ask.  Null
    ids and vectors that are null, zero or hold null or non-finite components take no
    part; vectors of different lengths are not compared.  Every row is indexed, in every
    table, and nothing is drawn from a sample.  ``probes`` is for the buckets of one
    rotation; with a second one it grows with the root of their number; None compares
    queries with all rows.  Each query has k rows if there are k others of its length.
    An empty table, or one without queries, gives no rows.
    """
    spark, scratch = df.sparkSession, scratch or Scratch(df.sparkSession)
    small_batches(spark)
    number = V.kind(df, vector)
    rows = df.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(V.usable(F.col("v")) & F.col("id").isNotNull())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in V.by_length(b, 1):
                own = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(2).take(own), pa.array(np.full(len(at), x.shape[1], np.int32)), V.packed(x, number)], names=["id", "asks", "length", "v"])

    rows = scratch.save(rows.mapInArrow(B.streamed(pack), "id long, asks boolean, length int, v binary"))
    tasks = max(24, -(-rows.count() // block))
    # one number for each length that occurs
    sizes = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.greatest(F.lit(least_blocks), F.ceil(F.col("n") / block)).cast("int"))

    def near(asked: DataFrame, probes: int | None) -> DataFrame:
        def compare(shard: pa.Table) -> pa.Table:
            ask, ids, n = shard["ask"].to_numpy(), shard["id"].to_numpy(), int(shard["n"][0].as_py())
            q, c = np.flatnonzero(ask), np.flatnonzero(~ask)
            x = V.unpacked(shard["v"], number)
            unit = V.unit(x.astype(np.float64)).astype(np.float32)
            out: list[list] = [[], [], []]
            index = Tables(unit[c], n, tables, probes, bucket_rows) if probes is not None and len(q) and len(c) else None
            rows_ = unit[c]
            for s in range(0, len(q) if len(c) else 0, 256):
                own = q[s : s + 256]
                may = np.ones((len(own), len(c)), bool) if index is None else index.candidates(unit[own])
                may &= ids[own][:, None] != ids[c][None, :]
                for i, j in enumerate(own.tolist()):
                    some = np.flatnonzero(may[i])
                    if not len(some):
                        continue
                    at, close = c[some], rows_[some] @ unit[j]
                    if len(at) > 4 * k:
                        # rounding must not decide a tie: all that come near the k-th are compared exactly
                        at_ = at[close >= np.partition(close, len(at) - k)[len(at) - k] - V.ROUNDING]
                    else:
                        at_ = at
                    score = V.cosine(x[at_], np.broadcast_to(x[j], (len(at_), x.shape[1])))
                    best = np.lexsort((ids[at_], -score))
                    _, first = np.unique(ids[at_][best], return_index=True)
                    best = best[np.sort(first)[:k]]
                    for column, v in zip(out, ([ids[j]] * len(best), ids[at_][best].tolist(), score[best].tolist()), strict=True):
                        column += v
            return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

        blocked = rows.join(sizes, "length").select("length", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(False).alias("ask"), "id", "n", "v")
        each = asked.join(sizes, "length").select("length", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("ask"), "id", "n", "v")
        # so many tasks however few the bytes: the work is in the comparisons
        found = blocked.unionByName(each).repartition(tasks, "length", "block").groupBy("length", "block").applyInArrow(B.grouped(compare), "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        # k rows of each block at most; no more than k of a query leave a partition
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return scratch.save(found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    asked = rows.filter("asks")
    got = near(asked, probes)
    if probes is None:
        return got
    enough = got.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = scratch.save(asked.join(enough, "id", "left_anti"))
    if not short.limit(1).count():
        return got
    rest = near(short, None)
    return got.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").select(got.columns).unionByName(rest)
