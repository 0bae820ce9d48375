"""Boxes and glyphs on pages: which stand in one line, one block, one column, and which two views see as the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafolio.operators.folds import folded

Names = list[str]
#: Fixed values of block merging: lines of a block, distance of left edges in points, ratio of sizes, characters of a line.
BLOCK_LINES, BLOCK_LEFT, BLOCK_SIZE, BLOCK_CHARS = 4, 24, 1.1, 130


def intersection(a: str, b: str) -> Column:
    """The area that two boxes (columns of left, top, right, bottom) share."""
    wide = F.greatest(F.lit(0.0), F.least(F.col(f"{a}.right"), F.col(f"{b}.right")) - F.greatest(F.col(f"{a}.left"), F.col(f"{b}.left")))
    high = F.greatest(F.lit(0.0), F.least(F.col(f"{a}.bottom"), F.col(f"{b}.bottom")) - F.greatest(F.col(f"{a}.top"), F.col(f"{b}.top")))
    return wide * high


def union_share(a: str, b: str) -> Column:
    """Intersection over union of two boxes; 0 where neither has an area."""
    area = lambda x: (F.col(f"{x}.right") - F.col(f"{x}.left")) * (F.col(f"{x}.bottom") - F.col(f"{x}.top"))
    both = intersection(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def relation(a: str, b: str) -> Column:
    """How box b stands to box a: whether their baselines (bottoms) are at most 2 apart, the offsets of their corners, and the share of
    the lower one's height that they have in common."""
    high = lambda x: F.col(f"{x}.bottom") - F.col(f"{x}.top")
    common = F.greatest(F.lit(0.0), F.least(F.col(f"{a}.bottom"), F.col(f"{b}.bottom")) - F.greatest(F.col(f"{a}.top"), F.col(f"{b}.top")))
    least = F.least(high(a), high(b))
    return F.struct(
        (F.abs(F.col(f"{a}.bottom") - F.col(f"{b}.bottom")) <= 2).alias("same_baseline"), (F.col(f"{b}.left") - F.col(f"{a}.left")).alias("right_by"),
        (F.col(f"{b}.top") - F.col(f"{a}.top")).alias("down_by"), F.when(least > 0, common / least).otherwise(0.0).alias("overlap"),
    )


def matched_boxes(left: DataFrame, right: DataFrame, page: Names, id_: str, box: str, least: float = 0.5) -> DataFrame:
    """One-to-one pairs (left_id, right_id, share) of boxes on a page: in the order of the left ids, each takes the box with which it
    shares most, ``least`` or more, of those not taken (the smaller id of equal ones).

    Only overlapping pairs reach the fold, which goes page by page."""
    a = left.select(*page, F.col(id_).alias("left_id"), F.col(box).alias("a_"))
    b = right.select(*page, F.col(id_).alias("right_id"), F.col(box).alias("b_"))
    met = a.join(b, page).withColumn("share", union_share("a_", "b_")).filter(F.col("share") >= least).select(*page, "left_id", "right_id", "share")

    def take(state: dict, x, y) -> bool:
        if x in state["done"] or y in state["taken"]:
            return False
        state["done"].add(x)
        state["taken"].add(y)
        return True

    order = ["left_id", F.desc("share"), "right_id"]
    return folded(met, page, order, ["left_id", "right_id"], lambda: {"done": set(), "taken": set()}, take, "kept", "boolean").filter("kept").drop("kept")


def layout_blocks(lines: DataFrame, page: Names, order: str, *, text: str, left: str, top: str, size: str, face: Names, pitch: Column) -> DataFrame:
    """Adds block, from 1 on each page: a line goes on the one before if it is no further down than ``pitch``, the left edges are at
    most 24 apart, the larger size is at most 1.1 times the smaller, the faces are alike, the line before doesn't end a sentence
    and neither is longer than 130 characters. A block has four lines at most, and a fifth begins a new one."""
    w = Window.partitionBy(*page).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    apart = [F.col(top) - before(top) > pitch, F.abs(F.col(left) - before(left)) > BLOCK_LEFT, F.greatest(F.col(size), before(size)) > BLOCK_SIZE * F.least(F.col(size), before(size))]
    apart += [~F.col(f).eqNullSafe(before(f)) for f in face]
    apart += [before(text).rlike(r"[.!?:;]\s*$"), F.length(text) > BLOCK_CHARS, F.length(before(text)) > BLOCK_CHARS]
    broken = F.lag(F.lit(1)).over(w).isNull()
    for c in apart:
        broken = broken | F.coalesce(c, F.lit(False))
    runs = lines.withColumn("run_", F.sum(broken.cast("int")).over(w))
    cut = runs.withColumn("cut_", (F.row_number().over(Window.partitionBy(*page, "run_").orderBy(order)) - 1) % BLOCK_LINES == 0)
    return cut.withColumn("block", F.sum(F.col("cut_").cast("int")).over(w)).drop("run_", "cut_")


def blank_bands(rows: DataFrame, page: Names, row: str, ink: Column, least: int) -> DataFrame:
    """Maximal runs of at least ``least`` rows of pixels without ink: first, last and their number."""
    blank = rows.filter(ink == 0).withColumn("run_", F.col(row) - F.row_number().over(Window.partitionBy(*page).orderBy(row)))
    return blank.groupBy(*page, "run_").agg(F.min(row).alias("first"), F.max(row).alias("last"), F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= least).drop("run_")


def visual_lines(glyphs: DataFrame, page: Names, order: str, *, baseline: str, top: str, bottom: str, scale: str) -> DataFrame:
    """Adds line, from 1 on each page: a glyph joins the line being read if its baseline is within half the line's scale (1 at least) of
    the line's, or if they overlap by half the lower one's height. The line's baseline and scale are its largest glyph's so far."""

    def fold(line: dict, b: float, t: float, d: float, s: float) -> int:
        near = line["n"] and abs(b - line["base"]) <= max(1.0, line["scale"] / 2)
        shared = line["n"] and min(d, line["bottom"]) - max(t, line["top"]) >= min(d - t, line["bottom"] - line["top"]) / 2
        if near or shared:
            line["top"], line["bottom"] = min(line["top"], t), max(line["bottom"], d)
            if s > line["scale"]:
                line["base"], line["scale"] = b, s
        else:
            line.update(n=line["n"] + 1, base=b, scale=s, top=t, bottom=d)
        return line["n"]

    return folded(glyphs, page, [order], [baseline, top, bottom, scale], lambda: {"n": 0}, fold, "line", "int")


def corridor_cuts(words: DataFrame, page: Names, row: str, left: str, right: str, word_gap: Column) -> DataFrame:
    """The gaps between neighbouring words of a row that run on as corridors: at least three word gaps wide, and of the two rows above
    and the two below at least one leaves half of the gap clear, with text on both sides of it."""
    w = Window.partitionBy(*page, row).orderBy(left)
    gaps = words.withColumn("to", F.lead(left).over(w)).withColumn("from", F.max(right).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    wide = gaps.filter((F.col("to") - F.col("from") >= 3 * word_gap) & (word_gap > 0)).select(*page, F.col(row).alias("row_"), "from", "to")
    near = wide.withColumn(row, F.explode(F.array(*[F.col("row_") + k for k in (-2, -1, 1, 2)])))
    other = words.select(*page, row, F.col(left).alias("l_"), F.col(right).alias("r_"))
    middle = (F.col("from") + F.col("to")) / 2
    seen = near.join(other, [*page, row]).groupBy(*page, "row_", "from", "to", row).agg(
        F.greatest(F.max("from"), F.max(F.when(F.col("l_") < middle, F.col("r_")))).alias("a_"), F.least(F.max("to"), F.min(F.when(F.col("l_") >= middle, F.col("l_")))).alias("b_"),
        F.count_if(F.col("l_") < middle).alias("before_"), F.count_if(F.col("l_") >= middle).alias("after_"),
    )
    clear = (F.col("b_") - F.col("a_") >= (F.col("to") - F.col("from")) / 2) & (F.col("before_") > 0) & (F.col("after_") > 0)
    return seen.groupBy(*page, F.col("row_").alias(row), "from", "to").agg(F.bool_or(clear).alias("corridor")).filter("corridor").drop("corridor")


def line_facts(lines: DataFrame, page: Names, doc: Names, *, left: str, right: str, text: str, key: str) -> DataFrame:
    """Adds what can be said of a line on its page: margins to the page's text extent, how far its middle is from the extent's, its
    characters and words, and how often its key stands elsewhere in the document."""
    on_page, alike = Window.partitionBy(*page), Window.partitionBy(*doc, key)
    low, high = F.min(left).over(on_page), F.max(right).over(on_page)
    return lines.withColumns({
        "left_margin": F.col(left) - low, "right_margin": high - F.col(right), "off_centre": (F.col(left) + F.col(right)) / 2 - (low + high) / 2,
        "chars": F.length(text), "words": F.regexp_count(F.col(text), F.lit(r"\S+")), "elsewhere": F.when(F.length(key) > 0, F.count(F.lit(1)).over(alike) - 1).otherwise(0),
    })
