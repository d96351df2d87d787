"""Tables as folders of parquet with atomic replacement.

A change to a table is ``new rows = f(old rows, change set)``. The new rows are
written to a version folder beside the old and then one small pointer with the next
number is renamed into place; readers take the newest pointer, so at every moment
they see the old version or the new one.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Table:
    """A table of versions under ``path``, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._lock = threading.RLock()
        if schema is not None and self.version is None:
            self.replace(spark.createDataFrame([], schema))

    def _pointers(self) -> list[tuple[int, str]]:
        """(number, name) of the pointers, oldest first."""
        root = self._path(self.path)
        names = [x.getPath().getName() for x in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted((int(n.rsplit("-", 1)[1]), n) for n in names if n.startswith("_current-"))

    @property
    def version(self) -> str | None:
        pointers = self._pointers()
        return self.spark.read.text(f"{self.path}/{pointers[-1][1]}").first()[0] if pointers else None

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.version}")

    def replace(self, rows: DataFrame, partition_by: list[str] | None = None) -> None:
        """Writes a version and makes it current; the one before is kept until the next change,
        since ``rows`` may still be read from it."""
        with self._lock:
            version, old = f"v-{uuid.uuid4().hex}", self.version
            writer = rows.write.option("compression", "zstd")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{version}")
            pointers = self._pointers()
            number = pointers[-1][0] + 1 if pointers else 1
            self.spark.createDataFrame([(version,)], "v string").coalesce(1).write.text(f"{self.path}/_new-{version}")
            if not self._fs.rename(self._path(f"{self.path}/_new-{version}"), self._path(f"{self.path}/_current-{number}")):
                raise OSError(f"{self.path}: version {number} was written by another")
            for _, name in pointers[:-1]:
                self._fs.delete(self._path(f"{self.path}/{name}"), True)
            for status in self._fs.listStatus(self._path(self.path)):
                name = status.getPath().getName()
                if name.startswith("v-") and name not in (version, old):
                    self._fs.delete(status.getPath(), True)

    def change(self, f: Callable[[DataFrame], DataFrame]) -> None:
        with self._lock:
            self.replace(f(self.read()))

    def append(self, rows: DataFrame) -> None:
        """Adds files to the current version; no row is rewritten."""
        with self._lock:
            rows.select(*self.read().columns).write.mode("append").option("compression", "zstd").parquet(f"{self.path}/{self.version}")

    def append_once(self, rows: DataFrame, name: str) -> bool:
        """``append`` under a name: False if it was done before. What a broken try left behind
        goes first, so a name's rows stand in the table once."""
        with self._lock:
            done = self._path(f"{self.path}/_batches/{name}")
            if self._fs.exists(done):
                return False
            folder, staged = f"{self.path}/{self.version}", f"{self.path}/_staged-{name}"
            for status in self._fs.globStatus(self._path(f"{folder}/batch-{name}-*.parquet")):
                self._fs.delete(status.getPath(), False)
            rows.select(*self.read().columns).write.mode("overwrite").option("compression", "zstd").parquet(staged)
            for i, status in enumerate(self._fs.globStatus(self._path(f"{staged}/part-*.parquet"))):
                self._fs.rename(status.getPath(), self._path(f"{folder}/batch-{name}-{i}.parquet"))
            self._fs.mkdirs(done)
            self._fs.delete(self._path(staged), True)
            return True

    def landed(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/_batches/{name}"))
