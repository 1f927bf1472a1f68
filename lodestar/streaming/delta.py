"""Evidence that arrives in batches, merged by key and version; batches that come again change nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables
from ..sources.listed import ListedTables


class EvidenceLog(ListedTables):
    """Batches of evidence in a folder: of each key the row with the highest version counts.

    A batch adds only rows that are newer than what is stored, so a row that comes again,
    in the same batch or another one, is not stored again.  A batch of a stream is known
    by its number and the stream's name: one that was finished is passed over, one that
    failed has left nothing that is read.

    A batch also writes by how much it changes the counts of each ticker and period: rows
    added less rows replaced.  ``tiers`` sums those and reads no evidence.

    A null version is the oldest, a null key a key like others.  Of rows with one key and
    version a stored one stays; within a batch the one with the highest hash does.
    Columns beyond ticker, published, confidence, the key and the version are kept as they are.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, key: str = "id", version: str = "revision", unit: str = "week"):
        self.spark, self.path, self.key, self.version, self.unit = spark, path or tables.shared_folder(spark), key, version, unit

    def _read(self, spark: SparkSession, kind: str, since: int = 0) -> DataFrame | None:
        names = [x["name"] for x in self._list()[1] if x["kind"] == kind and x["version"] > since]
        return spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{n}" for n in names]) if names else None

    def _counted(self) -> list:
        return [F.col("ticker").alias("ticker"), F.date_trunc(self.unit, F.col("published")).alias("period"), F.col("confidence").cast("double").alias("confidence")]

    def _newest(self, rows: DataFrame) -> DataFrame:
        """A row for each key; copies of a hot key are reduced before the shuffle."""
        whole = F.struct(*rows.columns)
        order = F.struct(F.col(self.version), F.xxhash64(*rows.columns))
        return rows.groupBy(F.col(self.key).alias("__key")).agg(F.max_by(whole, order).alias("row")).select("row.*")

    def _standing(self, stored: DataFrame) -> DataFrame:
        """Stored rows that no other of them has replaced: a key has one row of a version, and a replacement knows the one before."""
        if "__was" not in stored.columns:
            return stored
        gone = stored.filter("__was IS NOT NULL").select(F.col(self.key).alias("__key"), F.col("__was.__old").alias("__version"))
        same = F.col(self.key).eqNullSafe(F.col("__key")) & F.col(self.version).eqNullSafe(F.col("__version"))
        return stored.drop("__was").join(F.broadcast(gone) if tables.is_small(gone) else gone, same, "left_anti")

    def _entering(self, batch: DataFrame, verdicts: DataFrame) -> DataFrame:
        """The batch's rows that are stored, one a key, with __was.

        verdicts: (__key, __newest, __n, __was, enters) of the batch's keys.  Rows go through a shuffle only where more
        than one has a key, or where neither the keys that enter nor the others are few.
        """
        k = F.col(self.key)
        plain = F.col("enters") & (F.col("__n") == 1) & F.col("__was").isNull()
        others, entering = verdicts.filter(~plain), verdicts.filter("enters")
        if tables.is_small(entering):
            rows = batch.join(F.broadcast(entering), k.eqNullSafe(F.col("__key")))
        elif tables.is_small(others):
            rows = batch.join(F.broadcast(others), k.eqNullSafe(F.col("__key")), "left").filter("enters IS NULL OR enters")
        else:
            rows = batch.join(verdicts, k.eqNullSafe(F.col("__key"))).filter("enters")
        one = rows.filter("__n IS NULL OR __n = 1").select(*batch.columns, "__was")
        several = rows.filter(F.col("__n") > 1).filter(F.col(self.version).eqNullSafe(F.col("__newest"))).select(*batch.columns, "__was")
        order = F.struct(F.xxhash64(*batch.columns))
        chosen = several.groupBy(k.alias("__group")).agg(F.max_by(F.struct(*several.columns), order).alias("row")).select("row.*")
        return one.unionByName(chosen)

    def merge(self, batch: DataFrame, *, stream: str = "", number: int | None = None) -> int:
        """Stores what is newer than the stored rows; how many rows that is, 0 for a batch that was merged before.

        number: the batch's, given by the stream; without one the batch is taken as new.
        Of the stored rows only keys, versions and the counted columns are read.  They are
        not shuffled while the batch has at most MOST_BROADCAST keys; beyond, they and the batch's
        keys and versions are.  The rest of a row is, where it has to be: see _entering().
        """
        at, listed = self._list()
        if number is not None and any(x.get("stream") == stream and x.get("number") == number for x in listed):
            return 0
        spark, k, v = batch.sparkSession, self.key, self.version
        batch = batch.persist()
        try:
            stored = self._read(spark, "rows")
            keys = batch.groupBy(F.col(k).alias("__key")).agg(F.max(v).alias("__newest"), F.count(F.lit(1)).alias("__n"))
            if stored is None:
                verdicts = keys.withColumns({"__was": F.lit(None).cast("struct<ticker:string>"), "enters": F.lit(True)})
            else:
                old = stored.select(F.col(k).alias("__stored"), F.col(v).alias("__old"), F.struct(*self._counted()).alias("__counted"))
                if tables.is_small(keys):
                    old = old.join(F.broadcast(keys.select("__key")), F.col("__stored").eqNullSafe(F.col("__key")), "left_semi")
                old = old.groupBy("__stored").agg(F.max(F.struct("__old", "__counted")).alias("__was"))
                newer = (F.col("__newest") > F.col("__was.__old")) | (F.col("__was.__old").isNull() & F.col("__newest").isNotNull())
                verdicts = keys.join(old, F.col("__key").eqNullSafe(F.col("__stored")), "left").drop("__stored").withColumn("enters", F.col("__was").isNull() | F.coalesce(newer, F.lit(False)))
            changes = self._entering(batch, tables.save(verdicts, f"{self.path}/verdicts-{(passing := uuid.uuid4().hex)}"))
            name = uuid.uuid4().hex
            if stored is None:
                changes.drop("__was").write.parquet(f"{self.path}/rows-{name}")
                added = spark.read.parquet(f"{self.path}/rows-{name}").select(*self._counted(), F.lit(1).alias("sign"))
            else:
                changes.write.parquet(f"{self.path}/rows-{name}")
                written = spark.read.parquet(f"{self.path}/rows-{name}")
                gone = written.filter("__was IS NOT NULL").select("__was.__counted.*", F.lit(-1).alias("sign"))
                added = written.select(*self._counted(), F.lit(1).alias("sign")).unionByName(gone)
            sums = added.groupBy("ticker", "period").agg(F.sum("sign").alias("n"), F.sum(F.when(F.col("confidence").isNotNull(), F.col("sign"))).alias("known"), F.sum(F.col("sign") * F.col("confidence")).alias("total"))
            sums.write.parquet(f"{self.path}/tiers-{name}")
            kept = spark.read.parquet(f"{self.path}/rows-{name}").count()
            tables.delete(spark, f"{self.path}/verdicts-{passing}")
        finally:
            batch.unpersist()
        entry = {"version": at + 1, "stream": stream, "number": number}
        self._put(at + 1, [*listed, {"name": f"rows-{name}", "kind": "rows", **entry}, {"name": f"tiers-{name}", "kind": "tiers", **entry}])
        return kept

    def rows(self) -> DataFrame | None:
        """The newest row of each key; None in a new log."""
        stored = self._read(self.spark, "rows")
        return None if stored is None else self._standing(stored)

    def changes(self, since: int = 0) -> tuple[int, DataFrame | None]:
        """(position, rows stored after position ``since``): what a reader that was there last has missed."""
        rows = self._read(self.spark, "rows", since)
        return self._list()[0], None if rows is None else self._standing(rows)

    def tiers(self) -> DataFrame | None:
        """(ticker, period, n, confidence) of the newest rows, from the batches' counts alone."""
        sums = self._read(self.spark, "tiers")
        if sums is None:
            return None
        out = sums.groupBy("ticker", "period").agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("known")).alias("confidence"))
        return out.filter("n > 0")

    def compact(self) -> None:
        """One table of the newest rows, and one of the counts; numbers of finished batches stay known.

        A reader's position before the compaction sees all rows again.  Old tables stay for
        plans that read them, until the folder goes.
        """
        at, listed = self._list()
        rows, sums = self.rows(), self._read(self.spark, "tiers")
        if rows is None:
            return
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/rows-{name}")
        sums.groupBy("ticker", "period").agg(*[F.sum(c).alias(c) for c in ("n", "known", "total")]).write.parquet(f"{self.path}/tiers-{name}")
        # of each stream the finished numbers, without tables
        seen = [{"name": "", "kind": "seen", "version": x["version"], "stream": s, "number": n} for x in listed if x["kind"] in ("rows", "seen") for s, n in [(x.get("stream"), x.get("number"))] if n is not None]
        self._put(at + 1, [*seen, {"name": f"rows-{name}", "kind": "rows", "version": at + 1}, {"name": f"tiers-{name}", "kind": "tiers", "version": at + 1}])


def merge_available(stream: DataFrame, log: EvidenceLog, checkpoint: str, name: str) -> int:
    """Merges what the stream has, then stops; how many rows were new.  Later calls go on from the checkpoint.

    name: the stream's, the same for one checkpoint: with the batch's number it tells a batch that comes again.
    """
    added = []
    q = stream.writeStream.foreachBatch(lambda batch, number: added.append(log.merge(batch, stream=name, number=number)))
    q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sum(added)
