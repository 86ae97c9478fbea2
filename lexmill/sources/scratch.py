"""Tables in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a folder of
    this machine is set as the setting, but only in local mode: on a cluster,
    executors would write where nobody else can read."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is unset; on a cluster it has to name a shared folder")
        found = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage: a lost executor
    costs at most the stage that is running. Parquet keeps them small and lets
    the optimizer see their size, so that it broadcasts those that are small.

    The driver deletes them when it ends; ``drop`` and ``keep`` do so earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/lexmill-{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.base))

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.base}/{label}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            self._fs.delete(self._path(f"{self.base}/{label}"), True)

    def keep(self, *labels: str) -> None:
        """Drops all tables but these."""
        if self._fs.exists(self._path(self.base)):
            for found in self._fs.listStatus(self._path(self.base)):
                if found.getPath().getName() not in labels:
                    self._fs.delete(found.getPath(), True)
