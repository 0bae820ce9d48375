"""Merging documents: binding quotes to their source, carrying decisions, comparing outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]


def outline_diff(old: DataFrame, new: DataFrame, doc: Names, key: str, level: str, parent: str) -> DataFrame:
    """Headings of two versions by key: ADDED, REMOVED, LEVEL, PARENT (several may hold), SAME."""
    a = old.select(*doc, key, F.col(level).alias("old_level"), F.col(parent).alias("old_parent"), F.lit(True).alias("in_old"))
    b = new.select(*doc, key, F.col(level).alias("new_level"), F.col(parent).alias("new_parent"), F.lit(True).alias("in_new"))
    both = a.join(b, [*doc, key], "full")
    kept = F.col("in_old").isNotNull() & F.col("in_new").isNotNull()
    kinds = [
        F.when(F.col("in_old").isNull(), "ADDED"), F.when(F.col("in_new").isNull(), "REMOVED"), F.when(kept & ~F.col("old_level").eqNullSafe(F.col("new_level")), "LEVEL"),
        F.when(kept & ~F.col("old_parent").eqNullSafe(F.col("new_parent")), "PARENT"),
    ]
    said = F.array_compact(F.array(*kinds))
    return both.withColumn("kinds", F.when(F.size(said) > 0, F.array_join(said, ",")).otherwise("SAME"))


def region_plan(rows: DataFrame, doc: Names, changed: Column, most: float = 0.3) -> DataFrame:
    """What has to be read again: UNCHANGED, REGION, or FULL above the share ``most`` of changed rows."""
    counts = rows.groupBy(*doc).agg(F.count(F.lit(1)).alias("rows"), F.count_if(changed).alias("changed"))
    return counts.withColumn("plan", F.when(F.col("changed") == 0, "UNCHANGED").when(F.col("changed") > F.col("rows") * most, "FULL").otherwise("REGION"))


def moved_rows(old: DataFrame, new: DataFrame, table_: Names, key: str, place: str) -> DataFrame:
    """Rows whose key stands once on each side, at another place; keys that stand several times are uncertain."""
    side = lambda df, s: df.groupBy(*table_, key).agg(F.count(F.lit(1)).alias(f"{s}_n"), F.min(place).alias(f"{s}_place"))
    both = side(old, "old").join(side(new, "new"), [*table_, key])
    several = (F.col("old_n") > 1) | (F.col("new_n") > 1)
    return both.withColumn("status", F.when(several, "UNCERTAIN").when(F.col("old_place") != F.col("new_place"), "MOVED").otherwise("SAME"))


def verdicts(items: DataFrame, answers: DataFrame, doc: Names, key: str, order: str) -> DataFrame:
    """Each item with the first answer about it: KEPT, EXCLUDED, UNSURE, or MISSING without one."""
    first = answers.groupBy(*doc, key).agg(F.min_by("verdict", order).alias("verdict"))
    said = F.when(F.col("verdict") == "KEEP", "KEPT").when(F.col("verdict") == "EXCLUDE", "EXCLUDED").when(F.col("verdict").isNull(), "MISSING").otherwise("UNSURE")
    return items.join(first, [*doc, key], "left").withColumn("state", said).drop("verdict")


def inherited(rows: DataFrame, doc: Names, node: str, parent: str, value: str) -> DataFrame:
    """Adds effective: a row's own value or that of its nearest ancestor that has one, and whether the chain ran into a cycle. Each
    round doubles the ancestors looked at; a chain that is still open after as many as the largest document has rows is a cycle."""
    from stratafolio.storage import written

    state = rows.select("*", F.col(value).alias("effective"), F.col(parent).alias("up_"))
    largest = rows.groupBy(*doc).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(largest.bit_length() + 1):
        state = written(state, "inherited")
        if state.filter("effective IS NULL AND up_ IS NOT NULL").isEmpty():
            break
        above = state.select(*[F.col(d).alias(f"a_{d}") for d in doc], F.col(node).alias("a_node"), F.col("effective").alias("a_value"), F.col("up_").alias("a_up"))
        met = state.join(above, [F.col(d) == F.col(f"a_{d}") for d in doc] + [F.col("up_") == F.col("a_node")], "left")
        state = met.select(*rows.columns, F.coalesce("effective", "a_value").alias("effective"), F.when(F.col("effective").isNull() & F.col("a_value").isNull(), F.col("a_up")).alias("up_"))
    return state.withColumn("cycle", F.col("effective").isNull() & F.col("up_").isNotNull()).drop("up_")


def list_labels(rows: DataFrame, list_: Names, order: str, level: str, deepest: int = 9) -> DataFrame:
    """Adds label (as 1.2.1): counters of a multi-level list, in which a row begins its deeper levels anew. Word has
    ``deepest`` levels; a deeper row is an error."""
    out = rows.withColumn(level, F.when(F.col(level) > deepest, F.raise_error(F.lit(f"a list level beyond {deepest}")).cast("int")).otherwise(F.col(level)))
    for k in range(1, deepest + 1):
        era = Window.partitionBy(*list_).orderBy(order)
        out = out.withColumn(f"era_{k}", F.sum(F.when(F.col(level) < k, 1).otherwise(0)).over(era))
        inner = Window.partitionBy(*list_, f"era_{k}").orderBy(order)
        out = out.withColumn(f"c_{k}", F.sum(F.when(F.col(level) == k, 1).otherwise(0)).over(inner))
    parts = [F.when(F.col(level) >= k, F.greatest(F.col(f"c_{k}"), F.lit(1 if k else 0)).cast("string")) for k in range(1, deepest + 1)]
    return out.withColumn("label", F.concat_ws(".", *parts)).drop(*[f"era_{k}" for k in range(1, deepest + 1)], *[f"c_{k}" for k in range(1, deepest + 1)])
