"""Trees of headings: depth from parent edges, parents from levels, chains, sections. All by windows within a document, or by one pass
over it in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafolio.operators.folds import folded

Names = list[str]
ROOT, OUTSIDE = 0, -1
DEEPEST = 9


def levels(nodes: DataFrame, doc: Names, order: str, parent: str) -> DataFrame:
    """Adds resolution and level to headings (order from 1; parent: an order, 0 for a root, -1 for outside the tree).

    A parent must exist, come earlier and be in the tree. A level exists only if the whole chain of parents leads to a root; it is
    at most 9. As parents come earlier, one pass in order is enough: a task holds the steps of one document's headings.
    """

    def step(steps: dict[int, int], own: int | None, up: int | None) -> int:
        if up == OUTSIDE:
            return OUTSIDE
        found = 1 if up == ROOT else steps[up] + 1 if up in steps else 0
        if found and own is not None:
            steps[own] = found
        return found

    w = folded(nodes, doc, [order], [order, parent], dict, step, "steps_", "long")
    steps = F.col("steps_")
    kind = F.when(steps == OUTSIDE, "outside").when(steps == 0, "unresolved").when(F.col(parent) == ROOT, "root").otherwise("parent")
    return w.withColumn("resolution", kind).withColumn("level", F.when(steps > 0, F.least(steps, F.lit(DEEPEST)).cast("int"))).drop("steps_")


def _last_at(doc: Names, order: str, level: str, value: str) -> list[Column]:
    """For each level the latest earlier row's value."""
    w = Window.partitionBy(*doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return [F.last(F.when(F.col(level) == k, F.col(value)), ignorenulls=True).over(w) for k in range(1, DEEPEST + 1)]


def parents(rows: DataFrame, doc: Names, order: str, level: str) -> DataFrame:
    """Adds parent: the nearest earlier row with a smaller level; null for none."""
    last = rows.withColumns({f"l_{k}": c for k, c in enumerate(_last_at(doc, order, level, order), 1)})
    nearest = reduce(lambda a, k: F.greatest(a, F.when(F.col(level) > k, F.col(f"l_{k}"))), range(1, DEEPEST), F.lit(None).cast("long"))
    return last.withColumn("parent", nearest).drop(*[f"l_{k}" for k in range(1, DEEPEST + 1)])


def strict_parents(rows: DataFrame, doc: Names, order: str, depth: str) -> DataFrame:
    """Adds parent: the nearest earlier row one level up that no shallower row has cleared since; status root, parent or unresolved."""
    last = rows.withColumns({f"l_{k}": c for k, c in enumerate(_last_at(doc, order, depth, order), 1)})
    above = F.coalesce(*[F.when(F.col(depth) == k + 1, F.col(f"l_{k}")) for k in range(1, DEEPEST)])
    cleared = F.greatest(F.lit(0), *[F.when(F.col(depth) > k + 1, F.col(f"l_{k}")) for k in range(1, DEEPEST)])
    found = F.when(above > cleared, above)
    status = F.when(F.col(depth) == 1, "root").when(found.isNotNull(), "parent").otherwise("unresolved")
    return last.withColumn("parent", found).withColumn("status", status).drop(*[f"l_{k}" for k in range(1, DEEPEST + 1)])


def chains(rows: DataFrame, doc: Names, order: str, level: str, name: str) -> DataFrame:
    """Adds chain: the names from the outermost heading that the row stands under to its own, joined by " > ". A heading is on the
    stack while no row of its level or a smaller one came after it."""
    pair = rows.withColumn("pair_", F.struct(F.col(order).alias("o"), F.col(name).alias("n")))
    last = pair.withColumns({f"l_{k}": c for k, c in enumerate(_last_at(doc, order, level, "pair_"), 1)})
    on_stack = [
        F.when((F.col(level) > k) & (F.col(f"l_{k}.o") > F.greatest(F.lit(0), *[F.coalesce(F.col(f"l_{j}.o"), F.lit(0)) for j in range(1, k)])), F.col(f"l_{k}.n"))
        if k > 1
        else F.when(F.col(level) > 1, F.col("l_1.n"))
        for k in range(1, DEEPEST + 1)
    ]
    return last.withColumn("chain", F.concat_ws(" > ", *on_stack, name)).drop("pair_", *[f"l_{k}" for k in range(1, DEEPEST + 1)])


def section_ends(rows: DataFrame, doc: Names, order: str, level: str) -> DataFrame:
    """Adds end: the order of the next heading whose level is the same or smaller; null where the section runs to the end."""
    w = Window.partitionBy(*doc).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    ends = F.coalesce(*[F.when(F.col(level) == k, F.col(f"e_{k}")) for k in range(1, DEEPEST + 1)])
    nexts = {f"e_{k}": F.min(F.when(F.col(level) <= k, F.col(order))).over(w) for k in range(1, DEEPEST + 1)}
    return rows.withColumns(nexts).withColumn("end", ends).drop(*nexts)


def prefix_parents(rows: DataFrame, doc: Names, order: str, path: str) -> DataFrame:
    """Adds parent: the nearest earlier row whose path is this one's without its last component. Rows and what they ask for meet in
    one window, so there is no self join."""
    key = lambda c: F.array_join(c, ".")
    shorter = F.slice(path, F.lit(1), F.size(path) - 1)
    marks = rows.select("*", key(F.col(path)).alias("key_"), F.lit(True).alias("mark_"))
    asks = rows.filter(F.size(path) > 1).select("*", key(shorter).alias("key_"), F.lit(False).alias("mark_"))
    w = Window.partitionBy(*doc, "key_").orderBy(order, F.desc("mark_")).rowsBetween(Window.unboundedPreceding, -1)
    met = marks.unionByName(asks).withColumn("parent", F.last(F.when(F.col("mark_"), F.col(order)), ignorenulls=True).over(w))
    answered = met.filter("NOT mark_").drop("key_", "mark_")
    return answered.unionByName(rows.filter(F.size(path) <= 1).withColumn("parent", F.lit(None).cast(dict(rows.dtypes)[order])))


def materialised(proposals: DataFrame, doc: Names, route: str, id_: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """Elements with ids made of the route and their own id, the same in every run, and the edges (parent, child) between them; a parent
    that isn't among the elements makes no edge."""
    name = lambda c: F.concat(F.lit(f"structural:{route}:"), F.col(c).cast("string"))
    elements = proposals.withColumn("element", name(id_))
    known = proposals.select(*doc, F.col(id_).alias(parent)).distinct()
    edges = proposals.join(known, [*doc, parent], "left_semi").select(*doc, name(parent).alias("parent"), name(id_).alias("child")).distinct()
    return elements, edges


def admitted(elements: DataFrame, edges: DataFrame, doc: Names) -> DataFrame:
    """Elements with the parent that the edges give them, whatever they claim themselves, and state: DUPLICATE for an id that stands
    several times, SEVERAL_PARENTS, OK."""
    given = edges.groupBy(*doc, F.col("child").alias("element")).agg(F.count_distinct("parent").alias("n_"), F.min("parent").alias("given_"))
    times = F.count(F.lit(1)).over(Window.partitionBy(*doc, "element"))
    met = elements.select(*doc, "element").withColumn("times_", times).join(given, [*doc, "element"], "left")
    state = F.when(F.col("times_") > 1, "DUPLICATE").when(F.col("n_") > 1, "SEVERAL_PARENTS").otherwise("OK")
    return met.withColumn("state", state).select(*doc, "element", F.when(F.col("state") == "OK", F.col("given_")).alias("parent"), "state")


def titles(sections: DataFrame, doc: Names, order: str, level: str, shared: Column) -> DataFrame:
    """Adds title: leading sections that hold everything after them, so that chains are compared without them. The run of titles ends
    with the first section that something later stands beside or above, and before one whose key ``shared`` says another document has."""
    after = Window.partitionBy(*doc).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    upto = Window.partitionBy(*doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    holds = (F.min(level).over(after) > F.col(level)) & ~F.coalesce(shared, F.lit(False))
    return sections.withColumn("holds_", F.coalesce(holds, F.lit(False))).withColumn("title", F.bool_and("holds_").over(upto)).drop("holds_")


def final_rows(headings: DataFrame, grounding: DataFrame, doc: Names, node: str) -> DataFrame:
    """The canonical heading of each fact (node, text, level, parent, status): its text as grounded in the source if it is, its level and
    parent with the reason that they lack, and a fingerprint of what it says."""
    met = headings.join(grounding.select(*doc, node, F.col("text").alias("grounded_")), [*doc, node], "left")
    text = F.coalesce("grounded_", "text")
    why = F.when(F.col("grounded_").isNull(), "NOT_GROUNDED").when(F.col("level").isNull(), "LEVEL_UNRESOLVED").when(F.col("parent").isNull() & (F.col("level") > 1), "PARENT_UNRESOLVED")
    print_ = F.sha2(F.concat_ws(chr(31), text, F.coalesce(F.col("level").cast("string"), F.lit("")), F.coalesce(F.col("parent").cast("string"), F.lit(""))).cast("binary"), 256)
    return met.select(*doc, node, text.alias("text"), "level", "parent", why.alias("reason"), print_.alias("fingerprint"))
