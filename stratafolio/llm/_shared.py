"""Places that the driver and all executors share, and how their files are dealt."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafolio.storage import shared_dir, written

__all__ = ["open_fs", "shared_dir", "spread", "written"]

def spread(rows: DataFrame, most: int) -> DataFrame:
    """The few rows of a table one to a task (several beyond ``most`` tasks): numbered and dealt by the number, as hashes of names
    would leave tasks empty and others with several."""
    n = min(max(1, rows.count()), most)
    order = Window.orderBy(*rows.columns)
    return rows.withColumn("__sf_n", F.pmod(F.row_number().over(order), F.lit(n))).repartitionByRange(n, "__sf_n").drop("__sf_n")


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a URI (file, hdfs, s3, gs) or plain path, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else _slashes(uri))


def _slashes(uri: str) -> str:
    """Hadoop prints local paths as file:/a; Arrow wants file:///a."""
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else uri
