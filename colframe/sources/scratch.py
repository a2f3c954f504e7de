"""The folder that driver and executors share, and tables saved in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session gets a new folder; on a cluster that would be each machine's own, so it fails.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        master = sc.master or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="colframe-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    A table is deleted by drop(), and otherwise when the driver ends its session's Java machine in good order.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        """Deletes saved tables that nothing lazy reads any more."""
        jvm = self.spark._jvm
        for df in saved:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
