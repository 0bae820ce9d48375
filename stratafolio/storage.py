"""Intermediate tables in the folder that the cluster shares: a lineage cut that survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs on one machine, as in local tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/stratafolio"
_made: list[str] = []


def root_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``, else the context's checkpoint folder, else, on one machine, a
    local one. A cluster without either is an error, as its machines could not read each other's files."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if (own := spark.sparkContext.getCheckpointDir()) is not None:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINTS


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI below the folder that the cluster shares."""
    path = f"{root_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> int:
    """Deletes the folders that this driver has made so far and says how many there were. Results that still read them are
    lost, so call it when they have been consumed."""
    jvm = spark.sparkContext._jvm
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), len(_made)
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
