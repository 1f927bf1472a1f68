"""Tables that a plan builds once and reads several times, in the folder all machines share."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, deleted when the driver ends; where that is unset, on this machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    path = f"{base.rstrip('/')}/lodestar-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit; the folder is temporary
        pass


def save(df: DataFrame, path: str | None = None, *, row_group: int | None = None) -> DataFrame:
    """Writes and rereads: later plans start here, and lost executors cost a reread.

    row_group: bytes of a row group, small where filters on a sorted column should skip most of them.
    """
    path = path or shared_folder(df.sparkSession)
    writer = df.write.mode("overwrite")
    (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_code(spark: SparkSession) -> None:
    """Sends this package to workers that would not find it by themselves, once for each session."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.path.realpath(p or ".") for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    sc = spark.sparkContext
    if os.path.realpath(root) in known or getattr(sc, "_lodestar_sent", False):
        return
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lodestar-code-"), "lodestar"), "zip", root, "lodestar"))
    sc._lodestar_sent = True


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now, not whenever the driver next cleans up.

    A job's last references go a moment after it ends, hence the second round.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def bound_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Arrow batches of so many bytes at most, as texts may be long; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
    if not 0 < now <= size:
        spark.conf.set(name, str(size))


#: Up to so many small rows given by a caller are broadcast; beyond, both sides are shuffled.
MOST_BROADCAST = 100_000


def is_small(df: DataFrame, most: int = MOST_BROADCAST) -> bool:
    return df.limit(most + 1).count() <= most


def few_or_saved(df: DataFrame, most: int = 2000) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows as a local table with a broadcast hint, if there are at most ``most``; else written, without a hint."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return save(df), lambda d: d
    return df.sparkSession.createDataFrame(rows, df.schema), F.broadcast
