"""Queries of proposals, facts, chains and materialised trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafolio.operators import trees as R  # noqa: N812
from stratafolio.operators import validators as V
from stratafolio.plans.registry import query
from stratafolio.plans.trees import H, headings
from stratafolio.session import table

ROLES = {"A": ("O", "F"), "N": ("O",)}


@query("fv5_proposal_reasons", """WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS ord, l_partkey, l_suppkey % 9 AS occ, l_linenumber % 3 AS a, l_linenumber % 3 + l_quantity::INT % 12 AS b, l_returnflag AS type, l_linestatus AS role, l_linenumber + l_partkey % 5 AS level, CASE WHEN l_partkey % 4 > 0 THEN l_partkey % 6 END AS parent FROM lineitem)
  SELECT doc, ord, l_partkey, CASE WHEN occ = 8 THEN 'source-occurrence-not-grounded' WHEN occ = 7 THEN 'source-facts-missing' WHEN NOT (a < b AND b <= 10) THEN 'invalid-proposed-sources' WHEN type NOT IN ('A', 'N') THEN 'unsupported-structural-type'
  WHEN NOT (type = 'A' OR role = 'O') THEN 'incompatible-structural-role' WHEN level NOT BETWEEN 1 AND 9 THEN 'invalid-structural-level' WHEN parent = 5 THEN 'structural-parent-not-grounded' END AS reason FROM p""")
def fv5(spark, sf):
    i = table(spark, sf, "lineitem")
    a = F.col("l_linenumber") % 3
    p = i.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), "l_partkey", (F.col("l_suppkey") % 9).alias("occurrence"),
        F.array(F.struct(F.lit("s").alias("id"), a.alias("start"), (a + F.col("l_quantity").cast("int") % 12).alias("end"))).alias("proposed"), F.col("l_returnflag").alias("type"),
        F.col("l_linestatus").alias("role"), (F.col("l_linenumber") + F.col("l_partkey") % 5).alias("level"), F.when(F.col("l_partkey") % 4 > 0, F.col("l_partkey") % 6).alias("parent"),
    )
    docs = p.select("doc").distinct()
    observed = F.when(F.col("occurrence") < 7, F.array(F.struct(F.lit("s").alias("id"), F.lit(0).alias("start"), F.lit(10).alias("end")))).otherwise(F.expr("array()").cast("array<struct<id:string,start:int,end:int>>"))
    seen = docs.withColumn("occurrence", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))).withColumn("observed", observed)
    known = docs.withColumn("element", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    return V.proposal_reasons(p, seen, known, ["doc"], ROLES).select("doc", "ord", "l_partkey", "reason")


@query("fv6_selected_sources", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 11 = 0 THEN 2 WHEN l_linenumber < l_quantity::INT AND l_quantity::INT <= 30 AND l_suppkey % 5 <> 0 THEN 2 ELSE 0 END AS kept FROM lineitem""")
def fv6(spark, sf):
    span = lambda i, a, b: F.struct(F.lit(i).alias("id"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    observed = F.array(span("x", F.lit(0), F.lit(30)), span("y", F.lit(5), F.lit(9)))
    second = F.when(F.col("l_suppkey") % 5 == 0, F.lit("x")).otherwise(F.lit("y"))
    proposed = F.array(span("x", F.col("l_linenumber"), F.col("l_quantity")), F.struct(second.alias("id"), F.lit(5).alias("start"), F.lit(9).alias("end")))
    i = table(spark, sf, "lineitem").withColumn("proposed", F.when(F.col("l_partkey") % 11 != 0, proposed))
    return i.select("l_orderkey", "l_linenumber", "l_partkey", F.size(V.selected_sources(F.col("proposed"), observed)).alias("kept"))


@query("fv3_heading_decisions", """WITH d AS (SELECT o_custkey AS doc, o_orderkey AS id, o_orderkey % 40 AS unit, (o_orderkey % 3)::INT AS a, ((o_orderkey % 3) + o_orderkey % 7)::INT AS b, o_orderpriority LIKE '1%' AS odd FROM orders), u AS (SELECT DISTINCT doc, unit, 'ab cd' AS text FROM d WHERE unit < 35)
  SELECT doc, id, CASE WHEN text IS NULL THEN 'CONTEXT_MISSING' WHEN odd THEN 'ORIGIN_UNKNOWN' WHEN NOT (a >= 0 AND b > a AND b <= 5) THEN 'SPAN_OUTSIDE_TEXT' WHEN a NOT IN (0, 2, 3, 5) OR b NOT IN (0, 2, 3, 5) THEN 'OFF_BOUNDARY' END AS reason FROM d LEFT JOIN u USING (doc, unit)""")
def fv3(spark, sf):
    k = F.col("o_orderkey")
    origin = F.array(F.lit("style"), F.when(F.col("o_orderpriority").startswith("1"), "guess").otherwise("marker"))
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), k.alias("id"), (k % 40).alias("unit"), (k % 3).cast("int").alias("start"), (k % 3 + k % 7).cast("int").alias("end"), origin.alias("origins"))
    u = d.filter("unit < 35").select("doc", "unit").distinct().withColumn("text", F.lit("ab cd"))
    return V.heading_decisions(d, u, ["doc"], ["style", "marker"], F.array(*map(F.lit, (0, 2, 3, 5)))).select("doc", "id", "reason")


PARTS = """p AS (SELECT l_orderkey AS fact, l_linenumber AS place, l_partkey AS unit, CASE WHEN l_suppkey % 13 = 0 THEN 'other' WHEN l_linenumber % 2 = 1 THEN 'label' ELSE 'value' END AS role, (l_suppkey % 3)::INT AS a, (l_suppkey % 3 + l_quantity)::INT % 10 AS b, l_linestatus FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)"""


def fact_parts(spark, sf):
    i = table(spark, sf, "lineitem")
    first = i.groupBy(F.col("l_orderkey").alias("fact"), F.col("l_linenumber").alias("at")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x"))
    role = F.when(F.col("x.l_suppkey") % 13 == 0, "other").when(F.col("at") % 2 == 1, "label").otherwise("value")
    return first.select("fact", "at", F.col("x.l_partkey").alias("unit"), role.alias("role"), (F.col("x.l_suppkey") % 3).cast("int").alias("start"), ((F.col("x.l_suppkey") % 3 + F.col("x.l_quantity")).cast("int") % 10).alias("end"), F.col("x.l_suppkey").alias("s"))


@query("fv12_fact_reasons", f"""WITH {PARTS}, m AS (SELECT p.*, p_name AS text FROM p LEFT JOIN (SELECT * FROM part WHERE p_partkey % 50 > 0) ON p_partkey = unit),
  b AS (SELECT *, CASE WHEN text IS NULL THEN 'UNKNOWN_UNIT' WHEN role = 'other' THEN 'ROLE_UNKNOWN' WHEN NOT (a >= 0 AND b > a AND b <= length(text)) THEN 'SPAN_OUTSIDE_TEXT' END AS bad FROM m),
  f AS (SELECT fact, arg_min(bad, place) FILTER (bad IS NOT NULL) AS bad, bool_and(role = 'label') AS labels, coalesce(string_agg(substr(text, a + 1, b - a), chr(31) ORDER BY place), '') AS key FROM b GROUP BY fact)
  SELECT fact, coalesce(bad, CASE WHEN labels THEN 'LABEL_ONLY' WHEN row_number() OVER (PARTITION BY key, bad IS NULL AND NOT labels ORDER BY fact) > 1 THEN 'DUPLICATE_OF' END) AS reason FROM f""")
def fv12(spark, sf):
    units = table(spark, sf, "part").filter("p_partkey % 50 > 0").select(F.col("p_partkey").alias("unit"), F.col("p_name").alias("text"))
    return V.fact_reasons(fact_parts(spark, sf), units, ["fact"], "at")


@query("fv13_flags_of_facts", """WITH p AS (SELECT l_orderkey AS fact, CASE WHEN l_linenumber % 2 = 1 THEN 'label' ELSE 'value' END AS role, l_suppkey % 3 AS source, l_partkey % 50 AS unit, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 2 END AS tab, l_partkey % 4 AS rw, l_quantity > 45 AS merged, l_quantity > 3 AS certain, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey % 50 END AS label FROM lineitem),
  f AS (SELECT fact, count(DISTINCT source) > 1 AS f1, count(DISTINCT unit) > 1 AS f2, count(*) FILTER (role = 'value') > 1 AS f3, count(DISTINCT (coalesce(tab::VARCHAR, ''), coalesce(rw::VARCHAR, ''))) > 1 AS f4, bool_or(merged) AS f5, bool_or(NOT certain) AS f6,
   list(DISTINCT unit) FILTER (role = 'label') AS labels, list(DISTINCT label) FILTER (tab IS NOT NULL AND label IS NOT NULL) AS asked FROM p GROUP BY fact)
  SELECT fact, list_filter([CASE WHEN f1 THEN 'CROSS_SOURCE' END, CASE WHEN f2 THEN 'MULTIPLE_UNITS' END, CASE WHEN f3 THEN 'MULTIPLE_VALUES' END, CASE WHEN f4 THEN 'CROSS_ROW_OR_TABLE' END, CASE WHEN f5 THEN 'MERGED_CELL' END, CASE WHEN f6 THEN 'PATH_UNCERTAIN' END,
    CASE WHEN len(labels) > 0 AND len(list_filter(coalesce(asked, []), lambda x: NOT list_contains(labels, x))) > 0 THEN 'LABEL_NOT_ROW_LABEL' END], lambda x: x IS NOT NULL) AS flags FROM f""")
def fv13(spark, sf):
    p = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("fact"), F.when(F.col("l_linenumber") % 2 == 1, "label").otherwise("value").alias("role"), (F.col("l_suppkey") % 3).alias("source"), (F.col("l_partkey") % 50).alias("unit"),
        F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 2).alias("table"), (F.col("l_partkey") % 4).alias("row"), (F.col("l_quantity") > 45).alias("merged"), (F.col("l_quantity") > 3).alias("path_certain"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey") % 50).alias("label_unit"),
    )
    return V.fact_flags(p, ["fact"])


@query("fv14_run_state", """SELECT user_id, CASE WHEN sum((event_type = 'error')::INT) > 3 THEN 'FAILED' WHEN sum((value < 1)::INT) > 0 THEN 'GAPS' WHEN sum((value > 95)::INT) > 0 THEN 'REFUSED' ELSE 'COMPLETE' END AS state FROM (SELECT user_id, event_type, value FROM events) GROUP BY user_id""")
def fv14(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.greatest(F.count_if(F.col("event_type") == "error") - 3, F.lit(0)).alias("f"), F.count_if(F.col("value") < 1).alias("g"), F.count_if(F.col("value") > 95).alias("r"))
    return V.run_state(e, ["user_id"], F.col("f"), F.col("g"), F.col("r"))


@query("fv16_verified", "SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus = 'F' AND l_quantity <= 25 AS verified FROM lineitem")
def fv16(spark, sf):
    gaps = F.when(F.col("l_quantity") > 25, F.array(F.lit("size")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.verified(F.col("l_linestatus") == "F", gaps).alias("verified"))


@query("fv17_upload_route", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN 'UNSUPPORTED' WHEN l_returnflag <> l_linestatus THEN 'KIND_DIFFERS' END AS reason FROM lineitem")
def fv17(spark, sf):
    found = F.when(F.col("l_partkey") % 5 == 0, "unknown").otherwise(F.col("l_linestatus"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", V.upload_route(F.col("l_returnflag"), found).alias("reason"))


@query("fv15_chain_conflicts", f"""WITH RECURSIVE {H}, c AS (SELECT doc, ord, CASE WHEN parent = 0 THEN 'ROOT' WHEN parent = -1 THEN 'NONE' WHEN ord % 17 = 0 THEN NULL ELSE parent::VARCHAR END AS parent FROM n),
  e AS (SELECT c.doc, c.ord, c.parent, CASE WHEN c.parent IS NULL THEN 'PARENT_UNAVAILABLE' WHEN c.parent = 'NONE' THEN 'ANCESTOR_OUTSIDE_TREE' WHEN c.parent = 'ROOT' THEN 'ROOT' WHEN p.ord IS NULL THEN 'ANCESTOR_MISSING' WHEN p.ord >= c.ord THEN 'PARENT_NOT_EARLIER' END AS own FROM c LEFT JOIN c p ON p.doc = c.doc AND p.ord::VARCHAR = c.parent),
  w AS (SELECT doc, ord, ord AS place, own, parent FROM e UNION ALL SELECT w.doc, w.ord, e.ord, e.own, e.parent FROM w JOIN e ON e.doc = w.doc AND e.ord::VARCHAR = w.parent WHERE w.own IS NULL)
  SELECT doc, ord, nullif(own, 'ROOT') AS conflict, CASE WHEN own <> 'ROOT' THEN place::VARCHAR END AS met_at FROM w WHERE own IS NOT NULL""")
def fv15(spark, sf):
    name = F.when(F.col("parent") == 0, "ROOT").when(F.col("parent") == -1, "NONE").when(F.col("ord") % 17 == 0, F.lit(None)).otherwise(F.col("parent").cast("string"))
    n = headings(spark, sf).select("doc", "ord", F.col("ord").cast("string").alias("node"), name.alias("parent"))
    return V.chain_conflicts(n, ["doc"], "node", "ord", "parent").select("doc", "ord", "conflict", "met_at")


@query("t3_materialised", f"""WITH {H} SELECT DISTINCT c.doc, 'structural:outline:' || c.parent AS parent, 'structural:outline:' || c.ord AS child FROM n c JOIN n p ON p.doc = c.doc AND p.ord = c.parent""")
def t3(spark, sf):
    return R.materialised(headings(spark, sf).select("doc", "ord", "parent"), ["doc"], "outline", "ord", "parent")[1]


@query("t4_admitted", """WITH e AS (SELECT user_id AS doc, (event_id % 30)::VARCHAR AS element FROM events), g AS (SELECT user_id AS doc, (event_id % 30)::VARCHAR AS element, count(DISTINCT event_id % 7) AS n, min((event_id % 7)::VARCHAR) AS parent FROM events WHERE event_type = 'view' GROUP BY ALL),
  t AS (SELECT *, count(*) OVER (PARTITION BY doc, element) AS times FROM e), s AS (SELECT doc, element, g.parent, CASE WHEN times > 1 THEN 'DUPLICATE' WHEN n > 1 THEN 'SEVERAL_PARENTS' ELSE 'OK' END AS state FROM t LEFT JOIN g USING (doc, element)) SELECT doc, element, CASE WHEN state = 'OK' THEN parent END AS parent, state FROM s""")
def t4(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc"), (F.col("event_id") % 30).cast("string").alias("element"), "event_type", (F.col("event_id") % 7).cast("string").alias("parent"))
    return R.admitted(e, e.filter("event_type = 'view'").select("doc", "parent", F.col("element").alias("child")), ["doc"])


@query("t10_titles", f"""WITH {H}, k AS (SELECT doc, ord, level, coalesce(min(level) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) > level, false) AND id % 5 > 0 AS holds FROM n) SELECT doc, ord, bool_and(holds) OVER (PARTITION BY doc ORDER BY ord) AS title FROM k""")
def t10(spark, sf):
    return R.titles(headings(spark, sf), ["doc"], "ord", "level", F.col("id") % 5 == 0).select("doc", "ord", "title")


@query("pr5_final_rows", """WITH h AS (SELECT o_custkey AS doc, o_orderkey AS node, o_orderpriority AS text, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 4 + 1)::INT END AS level, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 10 END AS parent FROM orders), g AS (SELECT o_custkey AS doc, o_orderkey AS node, o_orderpriority || '!' AS t FROM orders WHERE o_orderstatus <> 'P')
  SELECT doc, node, coalesce(t, text) AS text, level, parent, CASE WHEN t IS NULL THEN 'NOT_GROUNDED' WHEN level IS NULL THEN 'LEVEL_UNRESOLVED' WHEN parent IS NULL AND level > 1 THEN 'PARENT_UNRESOLVED' END AS reason,
  sha256(coalesce(t, text) || chr(31) || coalesce(level::VARCHAR, '') || chr(31) || coalesce(parent::VARCHAR, '')) AS fingerprint FROM h LEFT JOIN g USING (doc, node)""")
def pr5(spark, sf):
    k = F.col("o_orderkey")
    h = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), k.alias("node"), F.col("o_orderpriority").alias("text"), F.when(k % 5 > 0, (k % 4 + 1).cast("int")).alias("level"), F.when(k % 3 > 0, k % 10).alias("parent"), "o_orderstatus")
    g = h.filter("o_orderstatus <> 'P'").select("doc", "node", F.concat("text", F.lit("!")).alias("text"))
    return R.final_rows(h, g, ["doc"], "node")


@query("pr8_compact_views", """SELECT o_orderkey, '{"alias":"S' || o_orderkey || '","level":' || o_orderkey % 4 || CASE WHEN o_orderstatus = 'F' THEN ',"text":"' || o_orderpriority || '"' ELSE '' END || '}' AS payload FROM orders""")
def pr8(spark, sf):
    from stratafolio.sources.outline import compact_view

    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("S"), F.col("o_orderkey")).alias("alias"), (F.col("o_orderkey") % 4).alias("level"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("text"))
    return o.select("o_orderkey", compact_view(["alias", "level", "text"]).alias("payload"))
