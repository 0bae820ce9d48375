"""Boxes on pages: rows, segments, overlaps, peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]


def iou(a: Names, b: Names) -> Column:
    """Intersection over union of two boxes, each named by its left, top, right and bottom column."""
    al, at, ar, ab = map(F.col, a)
    bl, bt, br, bb = map(F.col, b)
    wide, high = F.greatest(F.least(ar, br) - F.greatest(al, bl), F.lit(0)), F.greatest(F.least(ab, bb) - F.greatest(at, bt), F.lit(0))
    both = wide * high
    union = (ar - al) * (ab - at) + (br - bl) * (bb - bt) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def best_overlap(gold: DataFrame, lines: DataFrame, page: Names, least: float, order: str) -> DataFrame:
    """For each gold box (g_left ...) the line (left ...) of its page that overlaps most, the first of equal ones, if at least
    ``least``. Boxes meet on their page alone."""
    met = gold.join(lines, page).withColumn("iou", iou(["g_left", "g_top", "g_right", "g_bottom"], ["left", "top", "right", "bottom"])).filter(F.col("iou") >= least)
    best = Window.partitionBy(*page, "g_id").orderBy(F.desc("iou"), order)
    return met.withColumn("n_", F.row_number().over(best)).filter("n_ = 1").drop("n_")


def atoms(rows: DataFrame, doc: Names, order: str, beside: Column) -> DataFrame:
    """Adds row, segment and alias: a line beside the one before it is the next segment of its row, else a new row begins."""
    w = Window.partitionBy(*doc).orderBy(order)
    out = rows.withColumn("row", F.sum(F.when(F.coalesce(beside, F.lit(False)), 0).otherwise(1)).over(w))
    out = out.withColumn("segment", F.row_number().over(Window.partitionBy(*doc, "row").orderBy(order)))
    return out.withColumn("alias", F.format_string("L%04d:S%d", "row", "segment"))


def ink_rows(boxes: DataFrame, page: Names, left: str, right: str, gap: float, least: int, wide: float) -> DataFrame:
    """Boxes of a band joined to rows while the gap to what came before is at most ``gap``; rows of at least ``least`` boxes and so
    wide are kept."""
    w = Window.partitionBy(*page).orderBy(left, right)
    reach = F.max(right).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = boxes.withColumn("apart", F.coalesce(F.col(left) - reach > gap, F.lit(True))).withColumn("run", F.sum(F.col("apart").cast("int")).over(w))
    rows = cut.groupBy(*page, "run").agg(F.min(left).alias("left"), F.max(right).alias("right"), F.count(F.lit(1)).alias("marks"))
    return rows.filter((F.col("marks") >= least) & (F.col("right") - F.col("left") >= wide))


def peers(boxes: DataFrame, page: Names, id_: str, left: str, tolerance: float, nearest: int = 4) -> DataFrame:
    """Boxes of a page that start within ``tolerance`` of one another: how many, and the nearest ids."""
    a = boxes.select(*page, F.col(id_).alias("id"), F.col(left).alias("l"))
    b = boxes.select(*page, F.col(id_).alias("other"), F.col(left).alias("m"))
    met = a.join(b, page).filter((F.abs(F.col("l") - F.col("m")) <= tolerance) & (F.col("id") != F.col("other"))).withColumn("far", F.abs(F.col("id") - F.col("other")))
    found = met.groupBy(*page, "id").agg(F.count(F.lit(1)).alias("peers"), F.slice(F.sort_array(F.collect_list(F.struct("far", "other"))), 1, nearest).alias("s"))
    return found.withColumn("nearest", F.transform("s", lambda x: x["other"])).drop("s")


def table_labels(cells: DataFrame, table_: Names, row: str, column: str, text: str) -> DataFrame:
    """Adds row_label (the row's first cell) and column_header (the column's cell in the first row). Labels come by windows."""
    by_row, by_column = Window.partitionBy(*table_, row).orderBy(column), Window.partitionBy(*table_, column).orderBy(row)
    first = lambda c, w: F.first(F.when(F.col(c) == 1, F.col(text)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return cells.withColumn("row_label", first(column, by_row)).withColumn("column_header", first(row, by_column))
