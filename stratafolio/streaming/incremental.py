"""The batch operators on a stream of arriving documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, schema: str, *, files_per_batch: int = 100) -> DataFrame:
    """Parquet files that land in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def apply(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch operator on every micro-batch and writes its result below ``out``, in a folder per batch that a retried batch
    overwrites; stops when all that has arrived is done."""

    def batch(df: DataFrame, number: int) -> None:
        operator(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_versions(stream: DataFrame, key: str, time: str, lateness: str = "1 hour") -> DataFrame:
    """The number of revisions per key and hour, with a watermark that lets state go."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, "1 hour"), key).agg(F.count(F.lit(1)).alias("revisions"))
