"""Decisions about headings and what follows from them: status ladders, projections, edits of a tree, routing of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]


def projected(elements: DataFrame, overrides: DataFrame, key: Names, columns: Names) -> DataFrame:
    """Elements with the values that overrides give them, column by column; a null override keeps the element's own."""
    given = overrides.select(*key, *[F.col(c).alias(f"o_{c}") for c in columns])
    joined = elements.join(given, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"o_{c}"), F.col(c)) for c in columns}).drop(*[f"o_{c}" for c in columns])


def boundaries(text: Column) -> Column:
    """Offsets (in code points) where a token may begin or end: 0, the text's end, both sides of anything but letters and digits, and
    where letters and digits meet."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{N}", "1"), r"\p{L}", "a"), "[^1a]", ".")

    def places(kinds: Column) -> Column:
        edges = F.filter(F.sequence(F.lit(1), F.greatest(F.size(kinds) - 1, F.lit(1))), lambda i: (F.get(kinds, i - 1) != F.get(kinds, i)) | (F.get(kinds, i) == "."))
        return F.when(F.size(kinds) > 0, F.concat(F.array(F.lit(0)), edges, F.array(F.size(kinds)))).otherwise(F.array(F.lit(0)))

    # a lambda's variable is worked out once; an expression inside a lambda is, for every element
    return F.get(F.transform(F.array(F.filter(F.split(shape, ""), lambda c: c != "")), places), F.lit(0))


def worst_status(parts: DataFrame, by: Names, conflict: Column, confirmed: Column) -> DataFrame:
    """The status of a group of parts: CONFLICT if one conflicts, CORROBORATED if all are confirmed, else UNVERIFIED."""
    return parts.groupBy(*by).agg(F.when(F.bool_or(conflict), "CONFLICT").when(F.bool_and(confirmed), "CORROBORATED").otherwise("UNVERIFIED").alias("status"), F.count(F.lit(1)).alias("parts"))


def primary(rows: DataFrame, doc: Names, hint: Column, fallback: Column, order: str) -> DataFrame:
    """Adds node_key (the hint, else the fallback) and whether the row is its node's first."""
    keyed = rows.withColumn("node_key", F.coalesce(hint, fallback))
    return keyed.withColumn("primary", F.row_number().over(Window.partitionBy(*doc, "node_key").orderBy(order)) == 1)


def shifted(rows: DataFrame, doc: Names, order: str, level: str, at: str, delta: str, deepest: int = 9) -> DataFrame:
    """A subtree's levels moved: the row whose order is ``at`` and all up to the next of its level or smaller move by ``delta``. The edit
    is refused where a level would leave 1 to ``deepest``; then nothing moves."""
    w = Window.partitionBy(*doc).orderBy(order)
    root_level = F.max(F.when(F.col(order) == F.col(at), F.col(level))).over(Window.partitionBy(*doc))
    after = F.col(order) > F.col(at)
    stop = F.max(F.when(after & (F.col(level) <= F.col("root_")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("root_", root_level).withColumn("stop_", stop).withColumn("in_", (F.col(order) >= F.col(at)) & (F.col("stop_") == 0))
    fits = F.bool_and(F.when(F.col("in_"), (F.col(level) + F.col(delta)).between(1, deepest)).otherwise(F.lit(True))).over(Window.partitionBy(*doc))
    out = marked.withColumn("accepted", fits)
    return out.withColumn("new_level", F.when(F.col("in_") & F.col("accepted"), F.col(level) + F.col(delta)).otherwise(F.col(level))).drop("root_", "stop_", "in_")


def routed(facts: DataFrame, names: DataFrame, doc: Names, label: str) -> DataFrame:
    """Facts sent to the subsection (name, target) of their label: ROUTED if one has it, UNRESOLVED if several or none."""
    found = names.groupBy(*doc, F.col("name").alias(label)).agg(F.count(F.lit(1)).alias("n_"), F.min("target").alias("target"))
    out = facts.join(found, [*doc, label], "left")
    one = F.col("n_") == 1
    return out.withColumn("status", F.when(one, "ROUTED").otherwise("UNRESOLVED")).withColumn("target", F.when(one, F.col("target"))).drop("n_")


def two_line(lines: DataFrame, doc: Names, order: str, bare: Column, title: Column) -> DataFrame:
    """Bare headings joined with the title line that follows: marks each line head, consumed or plain. In a run in which every line is
    bare and may be a title, lines pair off from the first."""
    w = Window.partitionBy(*doc).orderBy(order)
    linked = lines.withColumn("bare_", bare).withColumn("title_", title)
    joins = F.col("bare_") & F.coalesce(F.lead("title_").over(w), F.lit(False))
    marked = linked.withColumn("joins_", joins)
    follows = F.coalesce(F.lag("joins_").over(w), F.lit(False))
    runs = marked.withColumn("follows_", follows).withColumn("run_", F.sum(F.when(F.col("follows_"), 0).otherwise(1)).over(w))
    place = F.row_number().over(Window.partitionBy(*doc, "run_").orderBy(order))
    role = F.when((place % 2 == 1) & F.col("joins_"), "head").when((place % 2 == 0) & F.col("follows_"), "consumed").otherwise("plain")
    return runs.withColumn("role", role).drop("bare_", "title_", "joins_", "follows_", "run_")


def split_body(text: Column, payload: str) -> Column:
    """(heading, body) of a line cut at its first colon or where the payload pattern begins, whichever comes first; a null body
    without either."""
    at_payload = F.regexp_instr(text, F.lit(payload))
    at_colon = F.instr(text, ":")
    spots = F.filter(F.array(at_payload, at_colon), lambda x: x > 1)
    cut = F.array_min(spots)
    heading = F.when(cut.isNull(), text).otherwise(F.substr(text, F.lit(1), cut - 1))
    return F.struct(F.regexp_replace(heading, r"^[ .:]+|[ .:]+$", "").alias("heading"), F.when(cut.isNotNull(), F.regexp_replace(F.substr(text, cut), r"^[ :]+|[ :]+$", "")).alias("body"))


def interval_parts(spans: DataFrame, doc: Names, start: str, end: str) -> DataFrame:
    """The stretches between all boundaries of a document's spans, with how many spans hold each; uncovered ones are left out."""
    edges = spans.select(*doc, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*doc, "e.at", "e.d")
    sums = edges.groupBy(*doc, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*doc).orderBy("at")
    parts = sums.withColumn("depth", F.sum("d").over(w)).withColumn("end", F.lead("at").over(w)).filter("depth > 0 AND end IS NOT NULL")
    return parts.select(*doc, F.col("at").alias("start"), "end", "depth")
