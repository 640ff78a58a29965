"""Shared scratch tables: lineage is cut by Parquet written under spark.checkpoint.dir."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one of our own only where that is unset and all runs in one process."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        set_dir = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


class Scratch:
    """Tables of one run, all under one new folder of the shared directory."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/lectern-{name}-{uuid.uuid4().hex}"
        self.made = 0

    def table(self, df: DataFrame, release: bool = False) -> DataFrame:
        """df written as Parquet and read back: later reads depend on these files alone.

        release: let shuffle files of the finished job go now, not only when the driver's heap is full.
        """
        self.made += 1
        path = f"{self.root}/{self.made:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lectern_path = path
        if release:
            del df
            gc.collect()
            self.spark._jvm.System.gc()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._lectern_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
