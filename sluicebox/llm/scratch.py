"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_folder


class Scratch:
    """Writes tables once and reads them back, which cuts lineage.

    A lost executor costs no recomputation of what has been written. ``drop``
    removes a table that later steps no longer read. With ``clean`` what was
    shuffled for a table goes as soon as it is written, not when the driver
    happens to collect its garbage.
    """

    #: Spark's setting for it; unset, shuffle files stay
    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str, clean: bool = False):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.clean = clean

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        before = self.spark.conf.get(self.CLEAN, "false")
        self.spark.conf.set(self.CLEAN, "true" if self.clean else before)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(self.CLEAN, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
