"""Tables written once below the folder that the session's executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a session on this machine alone gets a local one; any other
    is an error, since parts on the executors' own disks could not be read back."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    at = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return at


def saved(df: DataFrame, what: str) -> DataFrame:
    """df written and read back: its lineage ends there, and its size is known to the planner."""
    at = f"{shared_folder(df.sparkSession, what)}/table"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
