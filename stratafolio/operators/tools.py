"""The read-only questions that a reader asks of a document's lines. Each checks its arguments and caps what it returns; what is left
over is told with every row (total, has_more, next_offset)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]
#: The most lines of a page, of facts in a call, of a range of facts, and aliases of a span.
PAGE_LINES, FACT_LINES, FACT_RANGE, SPAN_ALIASES = 200, 24, 400, 8


class ArgumentError(ValueError):
    """An argument that no document could answer."""


def _range(name: str, value: int, least: int, most: int) -> int:
    if not least <= value <= most:
        raise ArgumentError(f"{name} must be from {least} to {most}")
    return value


def _paged(rows: DataFrame, doc: Names, order: str, offset: int, limit: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*doc).orderBy(order))
    cut = rows.withColumn("n_", n).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(*doc))).filter((F.col("n_") > offset) & (F.col("n_") <= offset + limit))
    more = F.col("total") > offset + limit
    return cut.withColumn("has_more", more).withColumn("next_offset", F.when(more, F.lit(offset + limit))).drop("n_")


def page_layout(lines: DataFrame, doc: Names, order: str, page: int, *, offset: int = 0, limit: int = PAGE_LINES) -> DataFrame:
    """The lines of a page of each document, from ``offset``; documents without the page have no rows."""
    _range("page", page, 1, 100_000), _range("offset", offset, 0, 100_000), _range("limit", limit, 1, PAGE_LINES)
    return _paged(lines.filter(F.col("page") == page), doc, order, offset, limit)


def facts_of_range(lines: DataFrame, doc: Names, order: str, first: int, last: int, key: str, *, offset: int = 0) -> DataFrame:
    """At most ``FACT_LINES`` lines of a range, each with how often its key stands in the whole document and where first."""
    if last < first or last - first + 1 > FACT_RANGE:
        raise ArgumentError(f"a range has from 1 to {FACT_RANGE} lines")
    _range("offset", offset, 0, 100_000)
    again = lines.filter(F.length(key) > 0).groupBy(*doc, key).agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("first_at"))
    return _paged(lines.filter(F.col(order).between(first, last)).join(again, [*doc, key], "left"), doc, order, offset, FACT_LINES)


def source_span(lines: DataFrame, aliases: list[str]) -> DataFrame:
    """The lines with the aliases asked for, named once each."""
    named = list(dict.fromkeys(aliases))
    _range("aliases", len(named), 1, SPAN_ALIASES)
    return lines.filter(F.col("alias").isin(named))


def overview(lines: DataFrame, doc: Names, page: str, size: str, k: int = 5) -> DataFrame:
    """Lines and pages of each document, and its ``k`` commonest sizes with their lines (the larger of equal ones first)."""
    sizes = lines.groupBy(*doc, size).agg(F.count(F.lit(1)).alias("n_"))
    most = F.row_number().over(Window.partitionBy(*doc).orderBy(F.desc("n_"), F.desc_nulls_last(size)))
    top = sizes.withColumn("r_", most).filter(F.col("r_") <= k).groupBy(*doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("r_", size, "n_"))), lambda x: F.concat_ws(":", x[size].cast("string"), x["n_"].cast("string"))).alias("sizes"))
    return lines.groupBy(*doc).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct(page).alias("pages")).join(top, doc)


def coverage(wanted: DataFrame, got: DataFrame, by: Names, item: str, order: str) -> DataFrame:
    """How an answer covers what was asked, per group: missing, unexpected and repeated items, and whether those it has come in order."""
    w = Window.partitionBy(*by).orderBy(order)
    asked = wanted.select(*by, item).distinct().withColumn("asked_", F.lit(1))
    told = got.withColumn("back_", F.col(item) < F.lag(item).over(w)).groupBy(*by, item).agg(F.count(F.lit(1)).alias("n_"), F.bool_or("back_").alias("back_"))
    met = asked.join(told, [*by, item], "full")
    out = met.groupBy(*by).agg(
        F.count_if(F.col("n_").isNull()).alias("missing"), F.count_if(F.col("asked_").isNull()).alias("unexpected"), F.count_if(F.col("n_") > 1).alias("repeated"),
        (~F.coalesce(F.bool_or("back_"), F.lit(False))).alias("in_order"),
    )
    return out.withColumn("equal", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("repeated") == 0) & F.col("in_order"))


def matched_by_id_or_text(left: DataFrame, right: DataFrame, by: Names, id_: str, text: str, row: str) -> DataFrame:
    """Pairs (left_row, right_row, how) of rows that agree: by an id that is theirs alone on either side; else by a text that is, unless
    both have an id, as different ids speak against it."""

    def alone(df: DataFrame, key: str, name: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*by, key))
        return df.filter(F.col(key).isNotNull()).withColumn("n_", n).filter("n_ = 1").select(*by, key, F.col(row).alias(name), *([F.col(id_).alias(f"{name}_id")] if key != id_ else []))

    ids = alone(left, id_, "left_row").join(alone(right, id_, "right_row"), [*by, id_]).select(*by, "left_row", "right_row", F.lit("id").alias("how"))
    texts = alone(left, text, "left_row").join(alone(right, text, "right_row"), [*by, text]).filter("left_row_id IS NULL OR right_row_id IS NULL").select(*by, "left_row", "right_row", F.lit("text").alias("how"))
    free = texts.join(ids.select(*by, "left_row"), [*by, "left_row"], "left_anti").join(ids.select(*by, "right_row"), [*by, "right_row"], "left_anti")
    return ids.unionByName(free)


def agreement(answers: DataFrame, items: DataFrame, by: Names, key: str, order: str, failed: Column) -> DataFrame:
    """The state of each item by its first answer: KEPT, EXCLUDED, UNSURE, MISSING without one, and FAILED where the review of its group did."""
    first = answers.groupBy(*by, key).agg(F.min_by("verdict", order).alias("v_"))
    met = items.join(first, [*by, key], "left")
    said = F.when(F.coalesce(failed, F.lit(False)), "FAILED").when(F.col("v_").isNull(), "MISSING").when(F.col("v_") == "KEEP", "KEPT").when(F.col("v_") == "EXCLUDE", "EXCLUDED").otherwise("UNSURE")
    return met.withColumn("state", said).drop("v_")
