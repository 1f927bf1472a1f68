"""An approximate index of vectors: rows lie by cell, and a query reads the cells nearest to it.

Cells are those of a bounded sample of the vectors themselves.  Unlike a graph that is
walked a hop at a time, a cell is a partition: it is read as a whole, cells are read in
parallel, and new rows are filed without touching old ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..functions import vectors as V
from . import retrieve


def _nearest_cells(centroids: np.ndarray, n: int):
    @F.pandas_udf("array<int>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.array(s.tolist(), float).reshape(len(s), centroids.shape[1])
            yield pd.Series([r[:n].astype(np.int32) for r in np.argsort(-(x @ centroids.T), 1, kind="stable")])

    return cells


@dataclass(frozen=True)
class CellIndex:
    """rows: (cell, id, v), v of length 1 or zeros; centroids: unit vectors, one for each cell."""

    rows: DataFrame
    centroids: np.ndarray

    @staticmethod
    def build(vectors: DataFrame, *, id_: str = "vec_id", vector: str = "embedding", cells: int | None = None, most_cells: int = 4096) -> CellIndex:
        """Files vectors of one length; of rows with one id the index keeps one.

        There are about as many cells as rows in each, up to ``most_cells``.
        """
        spark = vectors.sparkSession
        raw, path = tables.shared_folder(spark), tables.shared_folder(spark)
        # vectors may cost a model's work: they are made once, with no filter on them below
        made = tables.save(vectors.select(F.col(id_).alias("id"), F.col(vector).alias("raw")), raw)
        rows = tables.save(made.filter("id IS NOT NULL AND raw IS NOT NULL").select("id", V.normalize(F.col("raw")).alias("v")).dropDuplicates(["id"]), path)
        tables.delete(spark, raw)
        n = rows.count()
        cells = max(1, min(cells or round(math.sqrt(n)), most_cells, max(n, 1)))
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(cells).collect()  # most_cells rows at most
        centroids = np.array([r["v"] for r in sample], float).reshape(len(sample), -1) if sample else np.zeros((1, 1))
        filed = tables.save(CellIndex._filed(rows, centroids))
        tables.delete(spark, path)
        return CellIndex(filed, centroids)

    @staticmethod
    def _filed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
        return rows.select(_nearest_cells(centroids, 1)("v")[0].alias("cell"), "id", "v")

    def insert(self, vectors: DataFrame, *, id_: str = "vec_id", vector: str = "embedding", fresh: bool = False) -> CellIndex:
        """The index with more rows; ids that it has already stay as they are.

        fresh: the caller knows that the ids are new; then nothing filed is read.
        """
        new = vectors.filter(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_).alias("id"), V.normalize(F.col(vector)).alias("v")).dropDuplicates(["id"])
        new = new if fresh else new.join(self.rows.select("id"), "id", "left_anti")
        return CellIndex(self.rows.unionByName(tables.save(self._filed(new, self.centroids))), self.centroids)

    def search(self, asked: DataFrame, k: int, *, probes: int | None = None, among: DataFrame | None = None) -> DataFrame:
        """(query_id, id, distance, similarity, rank): the k nearest in the ``probes`` nearest cells.

        asked: (query_id, q).  With as many probes as cells the result is exact.
        ``among``: ids that may be returned; it applies before the k are chosen.
        """
        cells = len(self.centroids)
        probes = min(cells, probes or 2 + math.ceil(math.sqrt(cells)))
        q = asked.select("query_id", V.normalize(F.col("q")).alias("u"))
        rows = self.rows if among is None else self.rows.join(among.select("id"), "id", "left_semi")
        if probes == cells:  # every query meets every row, whatever its cell
            return retrieve.nearest_units(rows, q, k)
        q = q.withColumn("cell", F.explode(_nearest_cells(self.centroids, probes)("u")))
        # a cell that many rows fall into, as copies do, is dealt into several parts
        parts = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / retrieve.ROWS).cast("int").alias("parts")))
        rows = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
        q = q.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return retrieve.nearest_by_block(rows.select("cell", "part", "id", "v"), q.select("cell", "part", "query_id", "u"), k, "cell", "part")

    def stats(self) -> DataFrame:
        """One row: nodes, cells in use, dims, rows of the largest cell."""
        by_cell = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        return by_cell.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count(F.lit(1)).alias("cells"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).withColumn("dims", F.lit(self.centroids.shape[1]))


class VectorRetriever:
    """Builds an index over evidence, then answers queries: (query_id, id, similarity, rank)."""

    def __init__(self, embedder, *, characters: int = 512):
        self.embedder, self.characters, self.index, self.added = embedder, characters, None, 0

    def text(self) -> Column:
        return F.concat("title", F.lit(". "), F.substring("content", 1, self.characters))

    def build(self, evidence: DataFrame) -> VectorRetriever:
        texts = evidence.select("id", self.text().alias("text"))
        self.fitted = self.embedder.fit(texts)
        self.index = CellIndex.build(texts.select("id", self.fitted.embed(F.col("text")).alias("v")), id_="id", vector="v")
        return self

    def add(self, evidence: DataFrame, *, merge: int = 16) -> VectorRetriever:
        """Embeds and files more evidence, of new ids, as the index was fitted; every ``merge`` additions its tables become one."""
        if self.index is None:
            raise RuntimeError("build() comes first")
        vectors = evidence.select("id", self.fitted.embed(self.text()).alias("v"))
        self.index, self.added = self.index.insert(vectors, id_="id", vector="v", fresh=True), self.added + 1
        if self.added % merge == 0:
            self.index = CellIndex(tables.save(self.index.rows), self.index.centroids)
        return self

    def retrieve(self, asked: DataFrame, k: int = 25, *, probes: int | None = None, among: DataFrame | None = None) -> DataFrame:
        if self.index is None:
            raise RuntimeError("build() comes first")
        q = asked.select("query_id", self.fitted.embed(F.col("query")).alias("q"))
        return self.index.search(q, k, probes=probes, among=among).select("query_id", "id", "similarity", "rank")

    def stats(self) -> DataFrame:
        if self.index is None:
            raise RuntimeError("build() comes first")
        return self.index.stats()
