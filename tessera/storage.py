"""Tables and folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Only a local session may leave it unset: then it is a fresh folder of the one machine there is."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def settle(df: DataFrame, name: str = "dataset") -> DataFrame:
    """df written once to the shared folder and read back: no lineage, and no part lost with an executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Files under a folder with a suffix, through Spark's own file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(f.getPath()) for f in system.listStatus(at) if str(f.getPath()).endswith(suffix))


def broadcastable(df: DataFrame) -> bool:
    """Whether df's estimated size is below spark.sql.autoBroadcastJoinThreshold."""
    spark = df.sparkSession
    limit = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")))
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit
