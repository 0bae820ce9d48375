"""Greedy packing: rows in order go into a batch while it has room. Where a batch ends depends on where the one before ended, so
this is a fold over a document's sizes; it runs as one expression per document, in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Names = list[str]


def packed(rows: DataFrame, doc: Names, order: str, size: str, most_size: int, most_rows: int) -> DataFrame:
    """Batches of consecutive rows of at most ``most_size`` and ``most_rows``; a larger row is a batch of its own: batch (from 1), first
    and last order, rows, size."""
    listed = rows.groupBy(*doc).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("r"))
    kind = "array<struct<first:bigint,last:bigint,rows:int,size:bigint>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<first:bigint,last:bigint,rows:int,size:bigint>").alias("open"))

    def step(a, x):
        o, s = x["o"].cast("long"), x["s"]
        fits = a["open"].isNotNull() & (a["open"]["size"] + s <= most_size) & (a["open"]["rows"] < most_rows)
        grown = F.struct(a["open"]["first"].alias("first"), o.alias("last"), (a["open"]["rows"] + 1).alias("rows"), (a["open"]["size"] + s).alias("size"))
        fresh = F.struct(o.alias("first"), o.alias("last"), F.lit(1).alias("rows"), s.alias("size"))
        closed = F.when(a["open"].isNull() | fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))
        return F.struct(closed.alias("done"), F.when(fits, grown).otherwise(fresh).alias("open"))

    batches = F.aggregate("r", start, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    return listed.select(*doc, F.posexplode(batches).alias("at", "b")).select(*doc, (F.col("at") + 1).alias("batch"), "b.*")


def tokens_of(length):
    """The estimate of a text's tokens: its length by 1.85, rounded up."""
    return F.ceil(length / F.lit(1.85))
