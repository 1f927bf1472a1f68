"""A store of evidence that can be searched: upsert, filtered search, delete, count."""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..operators.ann_index import VectorRetriever
from ..operators.embed import Embedder, Router
from .listed import ListedTables


class VectorStore(ABC):
    @abstractmethod
    def upsert(self, rows: DataFrame) -> int:
        """Adds rows, or replaces those with the same id; how many."""

    @abstractmethod
    def search(self, asked: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
        """The k best live rows for each query (query_id, query): query_id, rank, similarity and the rows' columns."""

    @abstractmethod
    def delete(self, ids: Sequence) -> int:
        """Marks rows as deleted; how many were live."""

    @abstractmethod
    def count(self) -> int:
        """Live rows."""


class TableVectorStore(ListedTables, VectorStore):
    """Rows and deletions as tables in a folder; of each id the last entry counts.

    Failed changes and changes at once: see ListedTables.  A later session that opens the
    folder goes on with it.

    The index is fitted and built by a session's first search; later searches embed and
    file only what came since.  Replaced and deleted rows stay in it, masked, until
    ``reindex``.  ``compact`` makes one table of the live rows.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, embedder: Embedder | None = None, *, id_: str = "id"):
        self.spark, self.path, self.id = spark, path or tables.shared_folder(spark), id_
        self.embedder, self.retriever, self.indexed = embedder or Router(), None, 0

    def _append(self, rows: DataFrame, kind: str) -> str:
        version, listed = self._list()
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.withColumn("__version", F.lit(version + 1).cast("long")).write.parquet(f"{self.path}/{name}")
        self._put(version + 1, [*listed, {"name": name, "kind": kind, "version": version + 1}])
        return name

    def _read(self, kind: str, since: int = 0) -> DataFrame | None:
        names = [x["name"] for x in self._list()[1] if x["kind"] == kind and x["version"] > since]
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{n}" for n in names]) if names else None

    def _entries(self, *, whole: bool = True) -> DataFrame | None:
        """(__id, __version, there, row): there is false in a deletion; row only if whole."""
        out = None
        for kind in ("rows", "dead"):
            t = self._read(kind)
            if t is not None:
                row = F.struct(*[c for c in t.columns if c != "__version"]) if kind == "rows" else F.lit(None)
                own = t.select(F.col(self.id).alias("__id"), "__version", F.lit(kind == "rows").alias("there"), *([row.alias("row")] if whole else []))
                out = own if out is None else out.unionByName(own)
        return out

    def _last(self) -> DataFrame:
        """(__id, __version) of the live rows; texts are not read."""
        last = self._entries(whole=False).groupBy("__id").agg(F.max(F.struct("__version", "there")).alias("last"))
        return last.filter("last.there").select("__id", F.col("last.__version").alias("__version"))

    def _live(self) -> DataFrame | None:
        if self._read("rows") is None:
            return None
        last = self._entries().groupBy("__id").agg(F.max_by(F.struct("row", "__version"), "__version").alias("last"))
        return last.filter("last.row IS NOT NULL").select("last.row.*", "last.__version")

    def live(self) -> DataFrame | None:
        """The live rows; None in a new store."""
        rows = self._live()
        return None if rows is None else rows.drop("__version")

    def upsert(self, rows: DataFrame) -> int:
        name = self._append(rows.dropDuplicates([self.id]), "rows")
        return self.spark.read.parquet(f"{self.path}/{name}").count()

    def delete(self, ids: Sequence | DataFrame) -> int:
        live = self.live()
        if live is None:
            return 0
        kind = live.schema[self.id].dataType
        gone = ids.select(self.id) if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], f"`{self.id}` {kind.simpleString()}")
        gone = tables.save(self._last().select(F.col("__id").alias(self.id)).join(gone.distinct(), self.id, "left_semi"))
        n = gone.count()
        if n:
            self._append(gone, "dead")
        return n

    def compact(self) -> None:
        """One table of the live rows, each with the version it came with, in place of all; then the old ones go.

        A row keeps its version, so an index stays right.
        """
        live = self._live()
        if live is None:
            return
        version, listed = self._list()
        name = f"rows-{uuid.uuid4().hex}"
        live.write.parquet(f"{self.path}/{name}")
        self._put(version + 1, [{"name": name, "kind": "rows", "version": version}])
        for old in listed:
            fs, p = self._fs(old["name"])
            fs.delete(p, True)

    def reindex(self) -> None:
        """The next search fits and builds the index anew, over the live rows alone."""
        self.retriever, self.indexed = None, 0

    def count(self) -> int:
        return 0 if self._read("rows") is None else self._last().count()

    def _filed(self) -> VectorRetriever:
        """The index, with all rows up to the last version in it."""
        version = self._list()[0]
        keyed = lambda rows: rows.withColumn("id", F.struct(F.col(self.id).alias("id"), F.col("__version").alias("version")))
        if self.retriever is None:
            self.retriever = VectorRetriever(self.embedder, characters=600).build(keyed(self._live()))
        elif (new := self._read("rows", self.indexed)) is not None:
            self.retriever.add(keyed(new.filter(F.col("__version") > self.indexed)))
        self.indexed = version
        return self.retriever

    def search(self, asked: DataFrame, k: int = 10, where: Column | None = None, *, probes: int | None = None) -> DataFrame:
        live = self._live()
        if live is None:
            raise LookupError("the store is empty")
        key = F.struct(F.col("__id").alias("id"), F.col("__version").alias("version")).alias("id")
        allowed = self._last().select(key) if where is None else live.filter(where).withColumn("__id", F.col(self.id)).select(key)
        found = self._filed().retrieve(asked, k, probes=probes, among=allowed).select("query_id", "rank", "similarity", F.col("id.id").alias("__id"))
        columns = [c for c in live.columns if c != "__version"]
        return live.join(found, F.col(self.id) == F.col("__id")).select("query_id", "rank", "similarity", *columns)

    def stats(self) -> dict[str, int]:
        """Stored ids, live rows and deleted ones; compaction forgets the deleted."""
        entries = self._entries(whole=False)
        stored, live = (0 if entries is None else entries.filter("there").select("__id").distinct().count()), self.count()
        return {"stored": stored, "live": live, "deleted": stored - live}
