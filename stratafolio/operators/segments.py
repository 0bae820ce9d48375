"""Topic boundaries between lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafolio.operators.folds import folded


def block_cosine(lines: DataFrame, k: int = 3) -> DataFrame:
    """Per gap after a line (doc_id, gap): the cosine of the word sets of the k lines before and the k after. Texts are shuffled once, by
    document; words are cut after that and meet in a window, so no word is shuffled. Where lines are left out, the gaps between two
    are those that k lines reach."""
    there = lines.select("doc_id", F.col("ord").cast("int").alias("ord"), "text").repartition("doc_id").sortWithinPartitions("doc_id", "ord")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    by = Window.partitionBy("doc_id").orderBy("ord")
    around = F.collect_list(F.struct("ord", "words")).over(by.rangeBetween(1 - k, 2 * k - 1))
    cut = there.select("doc_id", "ord", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    near = cut.select("doc_id", "ord", around.alias("near"), F.lead("ord").over(by).alias("next")).filter("next > ord")
    gaps = near.select("doc_id", F.explode(F.sequence("ord", F.least(F.col("ord") + k - 1, F.col("next") - 1))).alias("gap"), "near")
    side = lambda first, last: F.array_distinct(F.flatten(F.transform(F.filter("near", lambda x: x["ord"].between(F.col("gap") + first, F.col("gap") + last)), lambda x: x["words"])))
    sides = gaps.select("doc_id", "gap", side(1 - k, 0).alias("a"), side(1, k).alias("b"))
    sums = sides.select("doc_id", "gap", F.size(F.array_intersect("a", "b")).alias("ab"), F.size("a").alias("aa"), F.size("b").alias("bb"))
    cosine = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.round(F.col("ab") / (F.sqrt("aa") * F.sqrt("bb")), 6))
    return sums.select("doc_id", "gap", cosine.alias("cosine")).filter("cosine IS NOT NULL")


def depths(gaps: DataFrame, doc: list[str], gap: str, cosine: str) -> DataFrame:
    """Adds depth to gaps: how far the cosine climbs from each to the peak on its left and to that on its right. A climb goes on while
    the next gap's is no smaller, so a peak is the last gap, in either direction, that the one before it doesn't reach."""

    def peak(order: Column) -> Column:
        by = Window.partitionBy(*doc).orderBy(order)
        before = F.lag(cosine).over(by)
        return F.last(F.when(before.isNull() | (before < F.col(cosine)), F.col(cosine)), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))

    both = gaps.withColumn("left_", peak(F.col(gap))).withColumn("right_", peak(F.desc(gap)))
    return both.withColumn("depth", F.round(F.col("left_") + F.col("right_") - 2 * F.col(cosine), 6)).drop("left_", "right_")


def capped_windows(lines: DataFrame, doc: list[str], order: str, size: str, *, most: int = 48, most_size: int = 28_000) -> DataFrame:
    """Adds window, from 0: lines in order, at most ``most`` of them and ``most_size`` in all; a larger line is a window by itself."""

    def step(state: dict, n: int | None) -> int:
        if state["lines"] and (state["lines"] == most or state["size"] + (n or 0) > most_size):
            state.update(window=state["window"] + 1, lines=0, size=0)
        state["lines"] += 1
        state["size"] += n or 0
        return state["window"]

    return folded(lines, doc, [order], [size], lambda: {"window": 0, "lines": 0, "size": 0}, step, "window", "int")


def stack_paths(rows: DataFrame, doc: list[str], order: str, heading: str, level: str, name: str) -> DataFrame:
    """Adds path, the names of the headings that a row stands under joined by " > ", and certain: false from a heading whose level isn't
    known up to the next one whose is. A heading's own name counts for the rows after it."""

    def step(state: dict, is_heading: bool | None, deep: int | None, own: str | None) -> str:
        told = f"{int(state['certain'])}{' > '.join(n for _, n in state['open'])}"
        if is_heading:
            if deep is None:
                state["certain"] = False
            else:
                state["open"] = [x for x in state["open"] if x[0] < deep] + [(deep, own or "")]
                state["certain"] = True
        return told

    out = folded(rows, doc, [order], [heading, level, name], lambda: {"open": [], "certain": True}, step, "told_", "string")
    return out.withColumn("path", F.expr("substring(told_, 2)")).withColumn("certain", F.col("told_").startswith("1")).drop("told_")
