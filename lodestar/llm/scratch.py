"""Tables that cut lineage, written to the folder all machines share."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a temporary folder, on one machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the workers where they would not find it by themselves."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.path.abspath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    sc = spark.sparkContext
    if root in map(os.path.realpath, known) or getattr(sc, "_lodestar_shipped", False):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="lodestar-code-"), "lodestar")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "lodestar"))
    sc._lodestar_shipped = True


def _bytes(setting: str) -> int:
    n, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", setting.lower()).groups()
    return int(n) * {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[unit.removesuffix("b") or unit]


def small_batches(spark: SparkSession, rows: int = 4096, size: int = 4 << 20) -> None:
    """Bounds an Arrow batch by rows and by bytes, as texts may be long.

    Lowers the session's settings where they are higher and never raises them.
    """
    ship_code(spark)
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < _bytes(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the DataFrame has a column of that name (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


class Scratch:
    """Intermediate tables of one operator call.

    ``save`` writes a DataFrame as Parquet below the shared folder and reads it
    back: lost executors then cost a reread, not a recomputation, and files stay
    compressed, with a codec that can be read in parts: of raw LZ4, Spark fails to read
    dictionaries above 32 KB when it filters by them.  Tables are deleted by ``drop`` or
    when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lodestar-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._delete, self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone at exit; the folder is temporary
            pass

    def save(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def digest(self, df: DataFrame) -> tuple:
        """(rows, 128 bits of their hashes in any order) of distinct rows: equal for equal tables, and hardly ever for others."""
        hashes = [F.bit_xor(F.xxhash64(*df.columns, F.lit(k))) for k in (0, 1)]
        return tuple(df.agg(F.count(F.lit(1)), *hashes).first())

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished jobs now, not whenever the driver next cleans up.

        A job's last references go a moment after it ends, hence the second round.
        """
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.25)

    def drop(self, df: DataFrame) -> None:
        """Deletes a saved table that nothing reads any more."""
        if path := getattr(df, "_scratch_path", None):
            self._delete(path)
