"""Window and sequence operators. Each takes the columns that name a document and the order in it; windows are partitioned by the
document, so that a corpus of any size is spread by documents and no operator needs a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]


def neighbours(df: DataFrame, doc: Names, order: str, column: str, n: int) -> DataFrame:
    """Adds before and after: the column's values on up to n rows either side, in order."""
    w = Window.partitionBy(*doc).orderBy(order)
    return df.withColumn("before", F.collect_list(column).over(w.rowsBetween(-n, -1))).withColumn("after", F.collect_list(column).over(w.rowsBetween(1, n)))


def islands(df: DataFrame, doc: Names, order: str, selected: Column) -> DataFrame:
    """Maximal runs of consecutive selected rows: first, last and size. Consecutive is by place, not by the order's value."""
    place = df.withColumn("place", F.row_number().over(Window.partitionBy(*doc).orderBy(order))).filter(selected)
    run = place.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy(*doc).orderBy(order)))
    return run.groupBy(*doc, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("size")).drop("run")


def blocks(df: DataFrame, doc: Names, order: str, breaks: Column, cap: int | None = None) -> DataFrame:
    """Adds block: numbered from 1, a new one where ``breaks`` holds (null on the first row counts), and every ``cap`` rows."""
    w = Window.partitionBy(*doc).orderBy(order)
    out = df.withColumn("block", F.sum(F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).over(w))
    if cap is None:
        return out
    inner = Window.partitionBy(*doc, "block").orderBy(order)
    part = F.floor((F.row_number().over(inner) - 1) / cap)
    starts = (F.row_number().over(inner) - 1) % cap == 0
    return out.withColumn("part", part).withColumn("starts", starts.cast("int")).withColumn("block", F.sum("starts").over(w)).drop("part", "starts")


def sequences(df: DataFrame, doc: Names, form: str, order: str, value: str, least: int = 2) -> DataFrame:
    """Numbered sequences of one form: maximal chains in which each value is its predecessor's plus one."""
    w = Window.partitionBy(*doc, form).orderBy(order)
    broken = F.coalesce(F.col(value) != F.lag(value).over(w) + 1, F.lit(True))
    chained = df.withColumn("chain", F.sum(broken.cast("int")).over(w))
    out = chained.groupBy(*doc, form, "chain").agg(F.min(order).alias("first"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("size"))
    return out.filter(F.col("size") >= least).drop("chain")


def anomalies(df: DataFrame, doc: Names, key: str, order: str, value: str) -> DataFrame:
    """Gaps, decreases and repeats of a numbered sequence: kind, order of the row, the value before and the row's, and how many
    numbers are missing (gaps only)."""
    w = Window.partitionBy(*doc, key).orderBy(order)
    before = F.lag(value).over(w)
    kind = F.when(F.col(value) > F.col("previous") + 1, "gap").when(F.col(value) < F.col("previous"), "decrease").when(F.col(value) == F.col("previous"), "repeat")
    missing = F.when(F.col("kind") == "gap", F.col(value) - F.col("previous") - 1)
    return df.withColumn("previous", before).withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("missing", missing)


def place_in_block(df: DataFrame, doc: Names, block: str, order: str) -> DataFrame:
    """Adds place, size and block_number (blocks counted by their first row)."""
    inner = Window.partitionBy(*doc, block)
    out = df.withColumn("place", F.row_number().over(inner.orderBy(order))).withColumn("size", F.count(F.lit(1)).over(inner)).withColumn("first_", F.min(order).over(inner))
    return out.withColumn("block_number", F.dense_rank().over(Window.partitionBy(*doc).orderBy("first_"))).drop("first_")


def crossings(df: DataFrame, doc: Names, old: str, new: str) -> DataFrame:
    """Rows of a permutation (old place, new place) that cross another: an earlier row went further, or a later one less far."""
    w = Window.partitionBy(*doc).orderBy(old)
    up = F.max(new).over(w.rowsBetween(Window.unboundedPreceding, -1))
    down = F.min(new).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("crosses", F.coalesce(up > F.col(new), F.lit(False)) | F.coalesce(down < F.col(new), F.lit(False)))


def moved_blocks(df: DataFrame, doc: Names, old: str, new: str) -> DataFrame:
    """Crossing rows that stay together: runs in which both places go up by one."""
    w = Window.partitionBy(*doc).orderBy(old)
    broken = (F.col(old) != F.lag(old).over(w) + 1) | (F.col(new) != F.lag(new).over(w) + 1)
    runs = blocks(crossings(df, doc, old, new).filter("crosses"), doc, old, broken)
    return runs.groupBy(*doc, "block").agg(F.min(old).alias("old_first"), F.min(new).alias("new_first"), F.count(F.lit(1)).alias("size"))


def since_same(df: DataFrame, doc: Names, definition: str, instance: str, order: str) -> DataFrame:
    """Adds since: rows of the same definition since the previous one of the same instance; null for an instance's first."""
    place = F.row_number().over(Window.partitionBy(*doc, definition).orderBy(order))
    out = df.withColumn("place_", place)
    before = F.lag("place_").over(Window.partitionBy(*doc, definition, instance).orderBy(order))
    return out.withColumn("since", F.col("place_") - before - 1).drop("place_")


def look_alikes(df: DataFrame, doc: Names, look: str, decision: str, request: str, least: int = 2, most: int = 24, limit: int = 8) -> DataFrame:
    """Per document the first groups of rows that look the same and were decided differently in different requests."""
    groups = df.groupBy(*doc, look).agg(F.count(F.lit(1)).alias("size"), F.countDistinct(decision).alias("decisions"), F.countDistinct(request).alias("requests"))
    bad = groups.filter(F.col("size").between(least, most) & (F.col("decisions") > 1) & (F.col("requests") > 1))
    return bad.withColumn("n", F.row_number().over(Window.partitionBy(*doc).orderBy(look))).filter(F.col("n") <= limit).drop("n")


def relative_position(df: DataFrame, doc: Names, y: str) -> DataFrame:
    """Adds position: (y - lowest) / span of the document, to three digits; 0 where all are equal."""
    w = Window.partitionBy(*doc)
    span = F.max(y).over(w) - F.min(y).over(w)
    return df.withColumn("position", F.when(span > 0, F.round((F.col(y) - F.min(y).over(w)) / span, 3)).otherwise(F.lit(0.0)))


def merged_spans(df: DataFrame, doc: Names, start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a document as one."""
    w = Window.partitionBy(*doc).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = blocks_by(df.withColumn("apart", F.coalesce(F.col(start) > reach, F.lit(True))), w)
    return runs.groupBy(*doc, "block").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("parts")).drop("block")


def blocks_by(df: DataFrame, w) -> DataFrame:
    return df.withColumn("block", F.sum(F.col("apart").cast("int")).over(w))


def near_change(df: DataFrame, doc: Names, order: str, changed: Column, reach: int) -> DataFrame:
    """Adds context_changed: whether a row within ``reach`` order values changed."""
    w = Window.partitionBy(*doc).orderBy(order).rangeBetween(-reach, reach)
    return df.withColumn("context_changed", F.max(changed.cast("int")).over(w) == 1)


def segment_gaps(df: DataFrame, row: Names, left: str, right: str, ties: Names = ()) -> DataFrame:
    """Segments of one visual row from left to right: number, count and the gaps to both neighbours. Segments without a place come last; of
    segments at one place, ``ties`` says which comes first."""
    w = Window.partitionBy(*row).orderBy(F.asc_nulls_last(left), F.asc_nulls_last(right), *ties)
    return df.withColumns({
        "segment": F.row_number().over(w), "segments": F.count(F.lit(1)).over(Window.partitionBy(*row)),
        "gap_before": F.col(left) - F.lag(right).over(w), "gap_after": F.lead(left).over(w) - F.col(right),
    })


def fixed_windows(df: DataFrame, doc: Names, order: str, lines: int = 48) -> DataFrame:
    """Adds window: consecutive windows of so many rows."""
    return df.withColumn("window", F.floor((F.row_number().over(Window.partitionBy(*doc).orderBy(order)) - 1) / lines))


def page(df: DataFrame, doc: Names, order: Names, offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit of each document, with total, has_more and next_offset."""
    w = Window.partitionBy(*doc)
    out = df.withColumn("n", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(w))
    out = out.filter(F.col("n").between(offset + 1, offset + limit))
    more = F.col("total") > offset + limit
    return out.withColumn("has_more", more).withColumn("next_offset", F.when(more, F.lit(offset + limit)))


def fitting(df: DataFrame, doc: Names, order: Names, size: Column, cap: int) -> DataFrame:
    """The longest prefix of each document whose sizes add up to at most ``cap``."""
    return df.withColumn("used", F.sum(size).over(Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("used") <= cap)


def top_k(df: DataFrame, doc: Names, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits the groups before the shuffle as well."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*doc).orderBy(*order))).filter(F.col("rank") <= k)
