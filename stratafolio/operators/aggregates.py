"""Aggregates whose tie rules and medians differ from the built-in ones. All combine on the map side unless they need order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]


def upper_middle(column: str) -> Column:
    """The element at index n / 2 (from 0) of the sorted values: of an even number the upper of the two middle ones."""
    sorted_ = F.array_sort(F.collect_list(column))
    return F.element_at(sorted_, (F.floor(F.count(column) / 2) + 1).cast("int"))


def dominant(df: DataFrame, by: Names, column: str, weight: Column | None = None, name: str = "dominant") -> DataFrame:
    """The value with the largest summed weight (default: rows); of equal ones the smallest. Nulls don't count."""
    sums = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.sum(weight if weight is not None else F.lit(1)).alias("w_"))
    best = sums.groupBy(*by).agg(F.max("w_").alias("top_"), F.min_by(column, F.struct(-F.col("w_"), F.col(column))).alias(name))
    return best.withColumnRenamed("top_", f"{name}_weight")


def style_table(df: DataFrame, doc: Names, style: Names, size: str, bold: str, name: str, order: str, example: str, top: int = 15, examples: int = 3) -> DataFrame:
    """Styles of a document: lines, rank by (size descending with null last, bold first, name), and the first examples."""
    groups = df.groupBy(*doc, *style).agg(F.count(F.lit(1)).alias("lines"), F.slice(F.sort_array(F.collect_list(F.struct(order, example))), 1, examples).alias("e"))
    place = F.row_number().over(Window.partitionBy(*doc).orderBy(F.desc_nulls_last(size), F.desc(bold), F.asc(name)))
    out = groups.withColumn("rank", place).filter(F.col("rank") <= top)
    return out.withColumn("examples", F.transform("e", lambda x: x[example])).drop("e")


def repeats(df: DataFrame, doc: Names, key: Column, page: str) -> DataFrame:
    """Adds how often a line's key recurs: other lines, pages, first and last page. An empty key never recurs."""
    keyed = df.withColumn("key_", key)
    found = keyed.filter(F.length("key_") > 0).groupBy(*doc, "key_").agg(
        F.count(F.lit(1)).alias("n_"), F.countDistinct(page).alias("pages"), F.min(page).alias("first_page"), F.max(page).alias("last_page")
    )
    joined = keyed.join(found, [*doc, "key_"], "left")
    return joined.withColumn("others", F.coalesce(F.col("n_") - 1, F.lit(0))).drop("n_", "key_")


def pitch(df: DataFrame, doc: Names, order: str, y: str, scale: Column, bucket: float = 0.05, share: float = 0.05) -> DataFrame:
    """The usual distance of lines: the smallest bucket of normalised distances that holds at least ``share`` of them, kept within 1
    to 2."""
    w = Window.partitionBy(*doc).orderBy(order)
    gaps = df.withColumn("gap", (F.col(y) - F.lag(y).over(w)) / scale).filter("gap > 0").withColumn("bucket", F.floor(F.col("gap") / bucket))
    counts = gaps.groupBy(*doc, "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(*doc)))
    low = counts.filter(F.col("n") >= share * F.col("total")).groupBy(*doc).agg(F.min("bucket").alias("bucket"))
    return low.withColumn("pitch", F.round(F.least(F.greatest(F.col("bucket") * bucket, F.lit(1.0)), F.lit(2.0)), 2))


def score(gold: DataFrame, predicted: DataFrame, doc: Names, key: Names) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 per document; a ratio with nothing below the line is null."""
    g = gold.select(*doc, *key).distinct().withColumn("g", F.lit(1))
    p = predicted.select(*doc, *key).distinct().withColumn("p", F.lit(1))
    both = g.join(p, [*doc, *key], "full").groupBy(*doc).agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp = F.col("tp")
    return both.withColumns({"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn")), "f1": ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn"))})


def error_rate(df: DataFrame, by: Names, gold: str, read: str) -> DataFrame:
    """Lines read exactly, and the sum of edit distances by the sum of gold lengths."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col(gold) == F.col(read)).alias("exact"),
        (F.sum(F.levenshtein(gold, read)) / F.nullif(F.sum(F.length(gold)), F.lit(0))).alias("error_rate"),
    )


def conflicts(df: DataFrame, doc: Names, label: Column, value: str) -> DataFrame:
    """Labels (case and spacing apart) that have more than one value."""
    groups = df.withColumn("label_key", label).groupBy(*doc, "label_key").agg(F.sort_array(F.collect_set(value)).alias("values"), F.count(F.lit(1)).alias("facts"))
    return groups.filter(F.size("values") > 1)


def first_kept(df: DataFrame, doc: Names, key: str, order: str) -> DataFrame:
    """Marks repeats: kept is the first row of its key, and every row names that row."""
    w = Window.partitionBy(*doc, key).orderBy(order)
    return df.withColumn("kept", F.row_number().over(w) == 1).withColumn("kept_order", F.first(order).over(w))


def also_in(df: DataFrame, key: str, place: str) -> DataFrame:
    """Adds the other places that have the same key, sorted."""
    places = F.collect_set(place).over(Window.partitionBy(key))
    return df.withColumn("also_in", F.sort_array(F.array_except(places, F.array(place))))


def level_shift(df: DataFrame, doc: Names, delta: str, least: int = 3) -> DataFrame:
    """Documents whose levels moved together: a non-zero delta of at least ``least`` rows and two thirds of all."""
    counts = df.filter(F.col(delta).isNotNull()).groupBy(*doc, delta).agg(F.count(F.lit(1)).alias("n"))
    total = counts.withColumn("total", F.sum("n").over(Window.partitionBy(*doc)))
    return total.filter((F.col(delta) != 0) & (F.col("n") >= least) & (3 * F.col("n") >= 2 * F.col("total")))


def at_share(column: str, share: float) -> Column:
    """The value at index floor(share * n) of the sorted ones: not an interpolated percentile."""
    sorted_ = F.array_sort(F.collect_list(column))
    return F.element_at(sorted_, (F.floor(F.count(column) * F.lit(share)) + 1).cast("int"))


def two_groups(df: DataFrame, doc: Names, value: str, least: int = 3) -> DataFrame:
    """Where values fall into two groups best: the cut (midpoint) with the largest variance between the groups, the earliest of equal
    ones; documents with fewer than ``least`` values have none."""
    order = Window.partitionBy(*doc).orderBy(value)
    all_ = Window.partitionBy(*doc)
    w = df.withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(all_)).withColumn("low_sum", F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    w = w.withColumn("total", F.sum(value).over(all_)).withColumn("next", F.lead(value).over(order)).filter((F.col("n") >= least) & F.col("next").isNotNull())
    gap = F.col("low_sum") / F.col("i") - (F.col("total") - F.col("low_sum")) / (F.col("n") - F.col("i"))
    spread = w.withColumn("spread", F.round(F.col("i") * (F.col("n") - F.col("i")) * gap * gap, 6))
    return spread.groupBy(*doc).agg(F.min_by(F.struct("i", ((F.col(value) + F.col("next")) / 2).alias("cut")), F.struct(-F.col("spread"), F.col("i"))).alias("b")).select(*doc, "b.i", "b.cut")
