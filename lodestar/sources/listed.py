"""Tables in a folder of which only listed ones count, so that failed changes leave no trace."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class ListedTables:
    """A folder of tables and of numbered lists of them; the last finished list is what readers see.

    A change writes one table under a name of its own, and then a new list, the last
    thing written.  What a failed change has left is in no list and is never read.  Two
    changes at once write the same list: one of them is an error and can be tried again.
    """

    spark: SparkSession
    path: str

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _list(self) -> tuple[int, list[dict]]:
        """(version, its tables) as the last finished list has them; a table: name, kind, version."""
        fs, p = self._fs("lists")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = sorted((n for n in names if n.isdigit() and fs.exists(self._fs(f"lists/{n}/_SUCCESS")[1])), key=int)
        return (int(done[-1]), json.loads(self.spark.read.text(f"{self.path}/lists/{done[-1]}").first()[0])) if done else (0, [])

    def _put(self, version: int, listed: list[dict]) -> None:
        """Makes the tables the folder's version, unless another change has made one."""
        fs, p = self._fs(f"lists/{version}")
        if fs.exists(p) and not fs.exists(self._fs(f"lists/{version}/_SUCCESS")[1]):
            fs.delete(p, True)  # left by a change that failed
        self.spark.createDataFrame([(json.dumps(listed),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{self.path}/lists/{version}")
