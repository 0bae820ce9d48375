"""Validators. Each gives a reason to every refused row, so that nothing is dropped unsaid: null is accepted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]


def first_reason(df: DataFrame, rules: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """Adds the name of the first rule that a row breaks; a rule that is null isn't broken."""
    clean = [(n, F.coalesce(c, F.lit(False))) for n, c in rules]
    return df.withColumn(name, reduce(lambda a, r: a.when(r[1], r[0]), clean[1:], F.when(clean[0][1], clean[0][0])))


def span_valid(start: str, end: str, length: Column) -> Column:
    return (F.col(start) >= 0) & (F.col(end) > F.col(start)) & (F.col(end) <= length)


def duplicates(df: DataFrame, by: Names, order: Names) -> Column:
    """Whether an earlier row has the same key."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) > 1


def checked(proposals: DataFrame, units: DataFrame, types: list[str], key: Names, order: Names) -> DataFrame:
    """Proposed spans (source_id, start, end, type) against units (source_id, length): unknown source, unknown type, span outside,
    duplicate of an earlier accepted-looking row, in this order."""
    joined = proposals.join(units, "source_id", "left")
    sound = F.col("length").isNotNull() & F.col("type").isin(types) & span_valid("start", "end", F.col("length"))
    marked = joined.withColumn("sound_", F.coalesce(sound, F.lit(False)))
    again = (F.row_number().over(Window.partitionBy(*key, "sound_").orderBy(*order)) > 1) & F.col("sound_")
    rules = [
        ("UNKNOWN_SOURCE", F.col("length").isNull()), ("TYPE_UNKNOWN", ~F.col("type").isin(types)), ("SPAN_OUTSIDE_TEXT", ~span_valid("start", "end", F.col("length"))),
        ("DUPLICATE", F.col("again_")),
    ]
    return first_reason(marked.withColumn("again_", again), rules).drop("sound_", "again_", "length")


def relations(edges: DataFrame, nodes: DataFrame, doc: Names) -> DataFrame:
    """Edges (parent, child) against nodes (node): missing endpoint, own parent, several parents; repeated edges are merged."""
    known = nodes.select(*doc, F.col("node"))
    e = edges.select(*doc, "parent", "child").distinct()
    e = e.join(known.withColumnRenamed("node", "parent").withColumn("has_parent", F.lit(True)), [*doc, "parent"], "left")
    e = e.join(known.withColumnRenamed("node", "child").withColumn("has_child", F.lit(True)), [*doc, "child"], "left")
    e = e.withColumn("parents", F.count(F.lit(1)).over(Window.partitionBy(*doc, "child")))
    rules = [("ENDPOINT_MISSING", F.col("has_parent").isNull() | F.col("has_child").isNull()), ("OWN_PARENT", F.col("parent") == F.col("child")), ("SEVERAL_PARENTS", F.col("parents") > 1)]
    return first_reason(e, rules).select(*doc, "parent", "child", "reason")


def sibling_conflicts(rows: DataFrame, doc: Names, order: str, signature: Column, parent: str) -> DataFrame:
    """Adds held: neighbours that look alike but name different parents, both of them."""
    w = Window.partitionBy(*doc).orderBy(order)
    marked = rows.withColumn("s_", signature)
    clash = lambda f: F.coalesce((f("s_").over(w) == F.col("s_")) & (f(parent).over(w) != F.col(parent)), F.lit(False))
    return marked.withColumn("held", clash(F.lag) | clash(F.lead)).drop("s_")


def catalog_faults(df: DataFrame, doc: Names, id_: str, length: Column, start: str, end: str) -> DataFrame:
    """Rows of a catalog that break its rules: empty id, duplicate id, invalid span."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*doc, id_))
    marked = df.withColumn("n_", n)
    rules = [("EMPTY_ID", F.coalesce(F.col(id_) == "", F.lit(True))), ("DUPLICATE_ID", F.col("n_") > 1), ("INVALID_SPAN", ~span_valid(start, end, length))]
    return first_reason(marked, rules).drop("n_").filter("reason IS NOT NULL")


def decision_runs(pairs: DataFrame, doc: Names, order: str, decision: str) -> DataFrame:
    """Groups from the decisions between neighbours: a SPLIT begins a new one."""
    w = Window.partitionBy(*doc).orderBy(order)
    out = pairs.withColumn("group_", F.sum(F.when(F.col(decision) == "SPLIT", 1).otherwise(0)).over(w))
    return out.groupBy(*doc, "group_").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("size")).drop("group_")


#: The reasons of a structural proposal in the order in which they are looked for, and the deepest level.
PROPOSAL_REASONS = (
    "source-occurrence-not-grounded", "source-facts-missing", "invalid-proposed-sources", "unsupported-structural-type", "incompatible-structural-role",
    "invalid-structural-level", "structural-parent-not-grounded",
)
DEEPEST_LEVEL = 9
#: Fixed value: the facts of an occurrence that a proposal names must lie in these roles of a fact's parts.
PART_ROLES = ("label", "value", "text")


def selected_sources(proposed: Column, observed: Column) -> Column:
    """The proposed sources (id, start, end) if every one lies in an observed source's raw span and no id is named twice, else none:
    one bad part empties the list. A null list proposes all that was observed."""
    inside = F.forall(proposed, lambda p: F.exists(observed, lambda o: (o["id"] == p["id"]) & (o["start"] <= p["start"]) & (p["start"] < p["end"]) & (p["end"] <= o["end"])))
    distinct = F.size(F.array_distinct(F.transform(proposed, lambda p: p["id"]))) == F.size(proposed)
    return F.when(proposed.isNull(), observed).when(inside & distinct, proposed).otherwise(F.slice(proposed, 1, 0))


def proposal_reasons(proposals: DataFrame, occurrences: DataFrame, elements: DataFrame, doc: Names, roles: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds ``reason``, the first of ``PROPOSAL_REASONS`` that holds, and ``accepted_sources`` to proposals (occurrence, proposed, type,
    role, level, parent). ``occurrences`` has (occurrence, observed), ``elements`` the known parents (element), and ``roles`` the
    roles that each type may have."""
    seen = occurrences.select(*doc, "occurrence", "observed", F.lit(True).alias("grounded_"))
    parents = elements.select(*doc, F.col("element").alias("parent"), F.lit(True).alias("known_")).distinct()
    met = proposals.join(seen, [*doc, "occurrence"], "left").join(parents, [*doc, "parent"], "left")
    met = met.withColumn("accepted_sources", selected_sources(F.col("proposed"), F.col("observed")))
    fits = F.lit(False)
    for kind, allowed in roles.items():
        fits = fits | ((F.col("type") == kind) & (F.col("role").isNull() | F.col("role").isin(*allowed)))
    broken = [
        F.col("grounded_").isNull(), F.coalesce(F.size("observed"), F.lit(0)) <= 0, F.size("accepted_sources") <= 0, ~F.col("type").isin(*roles), ~fits,
        ~F.col("level").between(1, DEEPEST_LEVEL), F.col("parent").isNotNull() & F.col("known_").isNull(),
    ]
    return first_reason(met, list(zip(PROPOSAL_REASONS, broken, strict=True))).drop("grounded_", "known_")


def heading_decisions(decisions: DataFrame, contexts: DataFrame, doc: Names, allowed: list[str], boundaries: Column) -> DataFrame:
    """Adds ``reason`` to decisions (unit, origins, start, end): CONTEXT_MISSING where no unit has the id, ORIGIN_UNKNOWN where one of its
    origins isn't ``allowed``, SPAN_OUTSIDE_TEXT, and OFF_BOUNDARY where either end isn't among the unit's ``boundaries``."""
    met = decisions.join(contexts.withColumn("known_", F.lit(True)), [*doc, "unit"], "left")
    strange = ~F.forall("origins", lambda o: o.isin(*allowed)) | (F.size("origins") == 0)
    off = ~(F.array_contains(boundaries, F.col("start")) & F.array_contains(boundaries, F.col("end")))
    rules = [("CONTEXT_MISSING", F.col("known_").isNull()), ("ORIGIN_UNKNOWN", strange), ("SPAN_OUTSIDE_TEXT", ~span_valid("start", "end", F.length("text"))), ("OFF_BOUNDARY", off)]
    return first_reason(met, rules).drop("known_")


def fact_reasons(parts: DataFrame, units: DataFrame, fact: Names, order: str) -> DataFrame:
    """Per fact of parts (unit, role, start, end): the reason of its first part that fails (UNKNOWN_UNIT, ROLE_UNKNOWN, SPAN_OUTSIDE_TEXT),
    LABEL_ONLY where no part is more than a label, DUPLICATE_OF an earlier sound fact with the same texts, or null. A fact with
    one bad part is refused whole."""
    met = parts.join(units.select("unit", F.col("text").alias("text_")), "unit", "left")
    bad = [("UNKNOWN_UNIT", F.col("text_").isNull()), ("ROLE_UNKNOWN", ~F.col("role").isin(*PART_ROLES)), ("SPAN_OUTSIDE_TEXT", ~span_valid("start", "end", F.length("text_")))]
    told = first_reason(met, bad, "bad_").withColumn("said_", F.expr("substr(text_, start + 1, end - start)"))
    at = F.array_sort(F.collect_list(F.struct(order, "said_")))
    facts = told.groupBy(*fact).agg(F.min_by("bad_", F.when(F.col("bad_").isNotNull(), F.col(order))).alias("bad_"), F.bool_and(F.col("role") == "label").alias("labels_"), F.array_join(F.transform(at, lambda x: x["said_"]), chr(31)).alias("key_"))
    sound = F.col("bad_").isNull() & ~F.col("labels_")
    known = facts.withColumn("key_", F.when(sound, F.sha2(F.col("key_").cast("binary"), 256)))
    firsts = known.filter("key_ IS NOT NULL").groupBy("key_").agg(F.min(F.struct(*fact)).alias("first_"))
    met = known.join(firsts, "key_", "left")
    reason = F.coalesce("bad_", F.when(F.col("labels_"), "LABEL_ONLY"), F.when(F.col("first_") != F.struct(*fact), "DUPLICATE_OF"))
    return met.select(*fact, reason.alias("reason"))


def fact_flags(parts: DataFrame, fact: Names) -> DataFrame:
    """What a reader must look at in facts whose parts (role, source, unit, table, row, merged, path_certain, label_unit) are sound, in
    this order: CROSS_SOURCE, MULTIPLE_UNITS, MULTIPLE_VALUES, CROSS_ROW_OR_TABLE, MERGED_CELL, PATH_UNCERTAIN, LABEL_NOT_ROW_LABEL.
    The last one: a table cell names its row's label, the fact has labels, and that one isn't among them."""
    several = lambda *c: F.count_distinct(*[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c]) > 1
    labels = F.collect_set(F.when(F.col("role") == "label", F.col("unit")))
    asked = F.collect_set(F.when(F.col("table").isNotNull() & F.col("label_unit").isNotNull(), F.col("label_unit")))
    seen = parts.groupBy(*fact).agg(
        several("source").alias("CROSS_SOURCE"), several("unit").alias("MULTIPLE_UNITS"), (F.count_if(F.col("role") == "value") > 1).alias("MULTIPLE_VALUES"),
        several("table", "row").alias("CROSS_ROW_OR_TABLE"), F.bool_or("merged").alias("MERGED_CELL"), F.bool_or(~F.col("path_certain")).alias("PATH_UNCERTAIN"),
        ((F.size(labels) > 0) & (F.size(F.array_except(asked, labels)) > 0)).alias("LABEL_NOT_ROW_LABEL"),
    )
    names = [c for c in seen.columns if c not in fact]
    return seen.select(*fact, F.array_compact(F.array(*[F.when(F.col(n), n) for n in names])).alias("flags"))


def run_state(runs: DataFrame, by: Names, failures: Column, gaps: Column, refusals: Column) -> DataFrame:
    """Whether a run is COMPLETE: without a failure, an unread gap or a refusal in any of its parts; else the first of FAILED, GAPS and
    REFUSED that holds."""
    seen = runs.groupBy(*by).agg(F.sum(failures).alias("f_"), F.sum(gaps).alias("g_"), F.sum(refusals).alias("r_"))
    return seen.withColumn("state", F.when(F.col("f_") > 0, "FAILED").when(F.col("g_") > 0, "GAPS").when(F.col("r_") > 0, "REFUSED").otherwise("COMPLETE")).drop("f_", "g_", "r_")


def verified(numbered: Column, gaps: Column) -> Column:
    """Whether a paragraph's looks are known: its numbering is resolved and nothing of its style is missing."""
    return F.coalesce(numbered, F.lit(False)) & (F.coalesce(F.size(gaps), F.lit(0)) <= 0)


def upload_route(said: Column, found: Column) -> Column:
    """Whether a file may go where its name says: by its bytes (``found``) and not by what was said of it."""
    return F.when(found.isNull() | (found == "unknown"), "UNSUPPORTED").when(~said.eqNullSafe(found), "KIND_DIFFERS")


def chain_conflicts(nodes: DataFrame, doc: Names, node: str, order: str, parent: str) -> DataFrame:
    """Adds conflict, the first trouble met on the way from a heading to its root, and where: ANCESTOR_MISSING (no such heading),
    ANCESTOR_OUTSIDE_TREE (NONE), ANCESTOR_UNRESOLVED, PARENT_UNAVAILABLE (no parent is given), or PARENT_NOT_EARLIER; null where
    the chain leads to ROOT. Each round doubles the steps that a pointer spans."""
    from stratafolio.storage import written

    p = F.col(parent)
    above = nodes.select(*doc, F.col(node).alias(parent), F.col(order).alias("o_"), F.lit(True).alias("known_"))
    own = (
        F.when(p.isNull(), "PARENT_UNAVAILABLE").when(p == "NONE", "ANCESTOR_OUTSIDE_TREE").when(p == "UNRESOLVED", "ANCESTOR_UNRESOLVED")
        .when(p == "ROOT", "ROOT").when(F.col("known_").isNull(), "ANCESTOR_MISSING").when(F.col("o_") >= F.col(order), "PARENT_NOT_EARLIER")
    )
    state = nodes.join(above, [*doc, parent], "left").select(*nodes.columns, own.alias("end_"), F.col(node).alias("at_"), F.when(own.isNull(), p).alias("next_"))
    while True:
        state = written(state, "chain-conflicts")
        if state.filter("next_ IS NOT NULL").isEmpty():
            break
        jump = state.select(*doc, F.col(node).alias("next_"), F.col("end_").alias("e_"), F.col("at_").alias("a_"), F.col("next_").alias("n_"))
        met = state.join(jump, [*doc, "next_"], "left")
        state = met.select(*nodes.columns, F.coalesce("end_", "e_").alias("end_"), F.when(F.col("end_").isNull(), F.col("a_")).otherwise(F.col("at_")).alias("at_"), F.when(F.col("end_").isNull(), F.col("n_")).alias("next_"))
    return state.withColumn("conflict", F.nullif("end_", F.lit("ROOT"))).withColumn("met_at", F.when(F.col("conflict").isNotNull(), F.col("at_"))).drop("end_", "at_", "next_")
