"""Cutting a plan where later steps read one result several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Tables that this process has settled, by application.
_SETTLED: dict[str, list[str]] = {}


def settled(df: DataFrame, by: str | None = None) -> DataFrame:
    """df, computed once: a table in the shared folder. Unlike a checkpoint it is read by column, and its size is known to joins. by: a column of few values to lay it out by."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    _SETTLED.setdefault(spark.sparkContext.applicationId, []).append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that this application has settled so far, and says how many; results built on them can't be read any more."""
    paths = _SETTLED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir, or one of its own where that is unset and all runs in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir", "")
        if not given and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}")
    return sc.getCheckpointDir()
