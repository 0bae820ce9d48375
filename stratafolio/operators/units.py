"""Units of a document in windows, batches and groups: planning what is read together, and checking what came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]


def ordered(rows: DataFrame, doc: Names, order: str, id_: str) -> DataFrame:
    """Adds place from 0: by the ordinal, then the id; rows that agree in both by what they hold, so that reruns agree."""
    w = Window.partitionBy(*doc).orderBy(F.asc_nulls_last(order), F.asc_nulls_last(id_), F.xxhash64(*rows.columns))
    return rows.withColumn("place", F.row_number().over(w) - 1)


def stable_sorted(rows: DataFrame, doc: Names, keys: list[Column], arrived: str) -> DataFrame:
    """Adds place from 1 by several keys, equal ones in the order in which they arrived."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*doc).orderBy(*keys, arrived)))


def page_windows(lines: DataFrame, doc: Names, page: str, block: str, order: str, most: int = 48) -> DataFrame:
    """Adds window: a page of at most ``most`` lines is one; else its layout blocks are packed into windows of at most ``most``
    lines, and a larger block is cut into slices of that size first.

    Packing takes pieces while they fit, so it depends on all pieces before: a fold over a page's pieces, a few dozen numbers.
    """
    on_page, in_block = Window.partitionBy(*doc, page), Window.partitionBy(*doc, page, block).orderBy(order)
    cut = lines.withColumn("n_", F.count(F.lit(1)).over(on_page)).withColumn("piece_", F.struct(F.min(order).over(Window.partitionBy(*doc, page, block)).alias("first"), F.floor((F.row_number().over(in_block) - 1) / most).alias("k")))
    pieces = cut.groupBy(*doc, page, "piece_").agg(F.count(F.lit(1)).alias("size")).groupBy(*doc, page).agg(F.sort_array(F.collect_list(F.struct("piece_", "size"))).alias("p"))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["size"] <= most
        at = F.when(fits, a["at"]).otherwise(a["at"] + 1)
        one = F.array(F.struct(x["piece_"].alias("piece_"), at.alias("at")))
        return F.struct(F.when(fits, a["used"] + x["size"]).otherwise(x["size"]).alias("used"), at.alias("at"), F.concat(a["out"], one).alias("out"))

    kind = f"array<struct<piece_:struct<first:{dict(lines.dtypes)[order]},k:bigint>,at:int>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    packed = pieces.select(*doc, page, F.explode(F.aggregate("p", start, step, lambda a: a["out"])).alias("x")).select(*doc, page, "x.piece_", F.col("x.at").alias("window_"))
    out = cut.join(packed, [*doc, page, "piece_"])
    return out.withColumn("window", F.when(F.col("n_") <= most, F.lit(0)).otherwise(F.col("window_"))).drop("n_", "piece_", "window_")


def scope_plan(units: DataFrame, doc: Names, order: str, sizes: list[tuple[str, str]], size: str, most: int) -> DataFrame:
    """Adds scope, a partition of a document's units into runs of at most ``most``: a scope is the document if it fits, else its parts
    of the first kind in ``sizes`` (name, column) that do, each part that doesn't fit by the next kind, and at last single units.
    Neighbouring parts are not joined; a unit larger than ``most`` is a scope by itself."""
    keys: list[str] = []
    scope = F.when(F.sum(size).over(Window.partitionBy(*doc)) <= most, F.lit("document"))
    for name, column in sizes:
        keys.append(column)
        scope = scope.when(F.sum(size).over(Window.partitionBy(*doc, *keys)) <= most, F.concat_ws(":", F.lit(name), *[F.col(k).cast("string") for k in keys]))
    return units.withColumn("scope", scope.otherwise(F.concat(F.lit("unit:"), F.col(order).cast("string"))))


def weakest(lines: DataFrame, doc: Names, line: str, confidence: Column, doubtful: Column, k: int) -> DataFrame:
    """The ``k`` doubtful lines of each document with the least confidence (unknown first), then the smaller id."""
    w = Window.partitionBy(*doc).orderBy(F.asc_nulls_first(confidence), line)
    return lines.filter(F.coalesce(doubtful, F.lit(False))).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def chosen_readings(lines: DataFrame, readings: DataFrame, keys: Names, chosen: str, default: str) -> DataFrame:
    """Each line's reading of the view chosen for it, else of the ``default`` view; blank ones are null and marked, so that they can be
    left out and counted."""
    views = readings.select(*keys, F.col("view").alias("view_"), F.col("reading").alias("reading_"))
    own = lines.join(views, [*[lines[k] == views[k] for k in keys], F.coalesce(lines[chosen], F.lit(default)) == views["view_"]], "left").select(lines["*"], "reading_")
    text = F.when(F.length(F.trim("reading_")) > 0, F.trim("reading_"))
    return own.withColumn("reading", text).withColumn("blank", text.isNull()).drop("reading_")


def for_review(windows: DataFrame, doc: Names, order: str, complete: Column, font: Column) -> DataFrame:
    """Of each document's complete windows the first, and that with the largest font (the earliest of equal ones): one or two rows."""
    whole = windows.filter(F.coalesce(complete, F.lit(False)))
    first = F.row_number().over(Window.partitionBy(*doc).orderBy(order))
    largest = F.row_number().over(Window.partitionBy(*doc).orderBy(F.desc_nulls_last(font), order))
    return whole.withColumn("first", first == 1).withColumn("largest", largest == 1).filter("first OR largest")


def rarest_line(lines: DataFrame, block: Names, pages: str, order: str) -> DataFrame:
    """The line of each block whose text stands on the fewest pages; the first of equal ones."""
    return lines.groupBy(*block).agg(F.min_by(order, F.struct(pages, order)).alias(order))


def audit_items(groups: DataFrame, reasons: DataFrame, doc: Names, group: str, alias: str, order: str) -> DataFrame:
    """Per group the first reason given for each of its lines, different ones in order, joined; null where none was given."""
    first = reasons.groupBy(*doc, alias).agg(F.min_by("reason", order).alias("reason"))
    met = groups.join(first, [*doc, alias], "left")
    said = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct(alias, "reason")))), lambda x: x["reason"]))
    out = met.groupBy(*doc, group).agg(F.count(F.lit(1)).alias("lines"), said.alias("said"))
    return out.withColumn("reasons", F.when(F.size("said") > 0, F.array_join("said", "; "))).drop("said")


def evidence_windows(targets: DataFrame, lines: DataFrame, page: Names, place: str, reach: int = 6) -> DataFrame:
    """The lines that are read for each page's targets, from ``reach`` before the first to ``reach`` after the last, and per page
    whether they hold every target."""
    span = targets.groupBy(*page).agg(F.min(place).alias("from_"), F.max(place).alias("to_"), F.count_distinct(place).alias("targets_"))
    wanted = targets.select(*page, place).distinct().withColumn("target", F.lit(True))
    read = lines.join(span, page).filter(F.col(place).between(F.col("from_") - reach, F.col("to_") + reach)).join(wanted, [*page, place], "left")
    held = F.count("target").over(Window.partitionBy(*page))
    return read.withColumn("complete", held == F.col("targets_")).withColumn("target", F.coalesce("target", F.lit(False))).drop("from_", "to_", "targets_")


def restored(bindings: DataFrame, doc: Names, heading: str, unit: str, said: Column, held: Column) -> DataFrame:
    """The one binding of each heading, if there is just one and its text is what the unit holds; else unit is null, with the reason
    SEVERAL or DIFFERS."""
    found = bindings.withColumn("good_", said.eqNullSafe(held)).groupBy(*doc, heading).agg(F.count_distinct(unit).alias("n_"), F.min(unit).alias("unit_"), F.bool_and("good_").alias("good_"))
    reason = F.when(F.col("n_") != 1, "SEVERAL").when(~F.col("good_"), "DIFFERS")
    return found.select(*doc, heading, F.when(reason.isNull(), F.col("unit_")).alias(unit), reason.alias("reason"))


def writeback(paragraphs: DataFrame, wanted: DataFrame, doc: Names, id_: str) -> DataFrame:
    """What is written back to each id: OK where just one paragraph has it, else MISSING or SEVERAL."""
    n = paragraphs.groupBy(*doc, id_).agg(F.count(F.lit(1)).alias("n_"))
    out = wanted.select(*doc, id_).distinct().join(n, [*doc, id_], "left")
    return out.withColumn("state", F.when(F.col("n_").isNull(), "MISSING").when(F.col("n_") > 1, "SEVERAL").otherwise("OK")).drop("n_")


def group_answers(answers: DataFrame, runs: DataFrame, doc: Names, run: str, heading: str, line: str, at: str, most: int = 8) -> DataFrame:
    """A verdict per run of lines that was asked about: OK, or the first fault of its answer. MISSING: no answer; UNCOVERED: a line that
    no heading holds, or one that wasn't asked; REPEATED: a line held twice; ORDER: lines out of order; SIZE: a heading of more than
    ``most`` lines. ``at`` is the answer's own order."""
    asked = runs.select(*doc, run, line).distinct()
    w = Window.partitionBy(*doc, run).orderBy(at)
    told = answers.withColumn("back_", F.col(line) <= F.lag(line).over(w)).withColumn("size_", F.count(F.lit(1)).over(Window.partitionBy(*doc, run, heading)))
    per = told.groupBy(*doc, run).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(line).alias("own"), F.bool_or("back_").alias("back"), F.max("size_").alias("size"))
    met = asked.join(answers.select(*doc, run, line).distinct().withColumn("told_", F.lit(1)), [*doc, run, line], "left").groupBy(*doc, run).agg(F.count(F.lit(1)).alias("asked"), F.count("told_").alias("covered"))
    out = met.join(per, [*doc, run], "left")
    fault = (
        F.when(F.col("n").isNull(), "MISSING").when((F.col("covered") < F.col("asked")) | (F.col("own") > F.col("covered")), "UNCOVERED").when(F.col("n") > F.col("own"), "REPEATED")
        .when(F.coalesce("back", F.lit(False)), "ORDER").when(F.col("size") > most, "SIZE").otherwise("OK")
    )
    return out.select(*doc, run, fault.alias("verdict"))


def observations(rows: DataFrame, by: Names, sums: Names, lists: Names) -> DataFrame:
    """Observations of several passes as one: counts are summed, lists put after one another (sorted, as passes have no order)."""
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums], *[F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in lists])


def block_statistics(lines: DataFrame, block: Names, size: str, bold: str, chars: str) -> DataFrame:
    """Per block of lines, by characters: the commonest size (the smaller of equal ones), the share of bold text, and all characters."""
    weight = F.sum(chars)
    sizes = lines.groupBy(*block, size).agg(weight.alias("c_"), F.sum(F.when(F.col(bold), F.col(chars)).otherwise(0)).alias("b_"))
    out = sizes.groupBy(*block).agg(F.min_by(size, F.struct(-F.col("c_"), F.col(size))).alias("size"), F.sum("b_").alias("b_"), F.sum("c_").alias("chars"))
    return out.withColumn("bold_share", F.when(F.col("chars") > 0, F.col("b_") / F.col("chars")).otherwise(0.0)).drop("b_")


def mapped_parts(facts: DataFrame, places: DataFrame, fact: Names, old: str, new: str) -> DataFrame:
    """Facts whose parts are carried from old places to new ones: MAPPED if all parts are, PARTLY, or UNMAPPED, with the new places."""
    one = places.groupBy(old).agg(F.count_distinct(new).alias("n_"), F.min(new).alias("to_")).filter("n_ = 1")
    met = facts.join(one, old, "left").groupBy(*fact).agg(F.count(F.lit(1)).alias("parts"), F.count("to_").alias("mapped"), F.array_sort(F.collect_set("to_")).alias("places"))
    return met.withColumn("state", F.when(F.col("mapped") == F.col("parts"), "MAPPED").when(F.col("mapped") > 0, "PARTLY").otherwise("UNMAPPED"))
