"""Queries of units: windows, batches, readings, bindings and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafolio.operators import units as U  # noqa: N812
from stratafolio.plans.lines import LINES
from stratafolio.plans.registry import query
from stratafolio.session import table
from stratafolio.sources.lines import lines


def documents_lines(spark, sf):
    return lines(table(spark, sf, "documents"))


@query("st1_ordered", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) - 1 AS place FROM lineitem")
def st1(spark, sf):
    return U.ordered(table(spark, sf, "lineitem"), ["l_orderkey"], "l_shipdate", "l_linenumber").select("l_orderkey", "l_linenumber", "place")


@query("st6_stable_sort", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, round(o_totalprice / 50000) DESC, o_orderkey) AS place FROM orders")
def st6(spark, sf):
    o = table(spark, sf, "orders").withColumn("size", F.round(F.col("o_totalprice") / 50000))
    return U.stable_sorted(o, ["o_custkey"], [F.asc("o_orderstatus"), F.desc("size")], "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query("g4_page_windows")
def g4(spark, sf):
    """Pages of 60 lines, blocks of 7 lines; at most 12 lines a window."""
    l = documents_lines(spark, sf).withColumn("page", F.floor((F.col("ord") - 1) / 60)).withColumn("block", F.floor((F.col("ord") - 1) / 7))  # noqa: E741
    return U.page_windows(l, ["doc_id"], "page", "block", "ord", 12).select("doc_id", "ord", "page", "block", "window")


@query("g5_scan_windows", f"""WITH {LINES}, p AS (SELECT doc_id, ord, (ord - 1) // 30 AS page FROM l) SELECT doc_id, ord, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1) // 20 AS window FROM p""")
def g5(spark, sf):
    """A scan has no layout blocks: each page is one block, cut every 20 lines."""
    l = documents_lines(spark, sf).withColumn("page", F.floor((F.col("ord") - 1) / 30)).withColumn("block", F.lit(0))  # noqa: E741
    return U.page_windows(l, ["doc_id"], "page", "block", "ord", 20).select("doc_id", "ord", "page", "window")


@query("w19_scope_plan", """WITH i AS (SELECT l_orderkey AS doc, l_returnflag AS part, l_linestatus AS sub, l_linenumber AS ord, l_quantity AS size FROM lineitem)
  SELECT doc, ord, CASE WHEN sum(size) OVER (PARTITION BY doc) <= 60 THEN 'document' WHEN sum(size) OVER (PARTITION BY doc, part) <= 60 THEN 'part:' || part WHEN sum(size) OVER (PARTITION BY doc, part, sub) <= 60 THEN 'sub:' || part || ':' || sub ELSE 'unit:' || ord END AS scope FROM i""")
def w19(spark, sf):
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("part"), F.col("l_linestatus").alias("sub"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("size"))
    return U.scope_plan(i, ["doc"], "ord", [("part", "part"), ("sub", "sub")], "size", 60).select("doc", "ord", "scope")


@query("g7_weakest", """SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value NULLS FIRST, event_id) AS rank FROM events WHERE event_type = 'error' OR value < 10) WHERE rank <= 3""")
def g7(spark, sf):
    e = table(spark, sf, "events")
    return U.weakest(e, ["user_id"], "event_id", F.col("value"), (F.col("event_type") == "error") | (F.col("value") < 10), 3).select("user_id", "event_id", "rank")


@query("g8_readings", """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'b' END AS view FROM customer),
  r AS (SELECT c_custkey, 'a' AS view, c_name AS reading FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 'b', CASE WHEN c_custkey % 2 = 0 THEN '  ' ELSE c_mktsegment END FROM customer)
  SELECT c.c_custkey, CASE WHEN length(trim(reading)) > 0 THEN trim(reading) END AS reading, coalesce(length(trim(reading)), 0) = 0 AS blank FROM c LEFT JOIN r ON c.c_custkey = r.c_custkey AND coalesce(c.view, 'a') = r.view""")
def g8(spark, sf):
    c = table(spark, sf, "customer")
    asked = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "b").alias("chosen"))
    a = c.filter("c_custkey % 7 <> 0").select("c_custkey", F.lit("a").alias("view"), F.col("c_name").alias("reading"))
    b = c.select("c_custkey", F.lit("b").alias("view"), F.when(F.col("c_custkey") % 2 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("reading"))
    return U.chosen_readings(asked, a.unionByName(b), ["c_custkey"], "chosen", "a").select("c_custkey", "reading", "blank")


@query("g11_for_review", """WITH w AS (SELECT o_custkey AS doc, o_orderkey AS ord, round(o_totalprice / 100000) AS font FROM orders WHERE o_orderstatus = 'F'),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord) = 1 AS first, row_number() OVER (PARTITION BY doc ORDER BY font DESC, ord) = 1 AS largest FROM w) SELECT doc, ord, first, largest FROM r WHERE first OR largest""")
def g11(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), "o_orderstatus", F.round(F.col("o_totalprice") / 100000).alias("font"))
    return U.for_review(o, ["doc"], "ord", F.col("o_orderstatus") == "F", F.col("font")).select("doc", "ord", "first", "largest")


@query("g14_rarest_line", f"""WITH {LINES}, k AS (SELECT doc_id, ord, (ord - 1) // 5 AS block, count(*) OVER (PARTITION BY lower(text)) AS pages FROM l) SELECT doc_id, block, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY pages, ord) AS r FROM k) WHERE r = 1""")
def g14(spark, sf):
    l = documents_lines(spark, sf).withColumn("key", F.md5(F.lower("text").cast("binary")))  # noqa: E741
    n = l.groupBy("key").agg(F.count(F.lit(1)).alias("pages"))
    met = l.select("doc_id", "ord", "key", F.floor((F.col("ord") - 1) / 5).alias("block")).join(n, "key")
    return U.rarest_line(met, ["doc_id", "block"], "pages", "ord").select("doc_id", "block", "ord")


@query("g15_audit_items", """WITH g AS (SELECT l_orderkey AS doc, l_returnflag AS grp, l_linenumber AS alias FROM lineitem), r AS (SELECT l_orderkey AS doc, l_linenumber % 4 + 1 AS alias, arg_min(l_linestatus || l_returnflag, (l_linenumber, l_linestatus || l_returnflag)) AS reason FROM lineitem WHERE l_quantity > 10 GROUP BY ALL),
  m AS (SELECT doc, grp, alias, reason FROM g LEFT JOIN r USING (doc, alias)), f AS (SELECT doc, grp, reason, min(alias) AS a FROM m WHERE reason IS NOT NULL GROUP BY ALL), s AS (SELECT doc, grp, string_agg(reason, '; ' ORDER BY a) AS reasons FROM f GROUP BY ALL)
  SELECT doc, grp, count(*) AS lines, any_value(reasons) AS reasons FROM m LEFT JOIN s USING (doc, grp) GROUP BY doc, grp""")
def g15(spark, sf):
    i = table(spark, sf, "lineitem")
    g = i.select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("alias"))
    r = i.filter("l_quantity > 10").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 4 + 1).alias("alias"), F.concat("l_linestatus", "l_returnflag").alias("reason"), F.struct("l_linenumber", F.concat("l_linestatus", "l_returnflag")).alias("at"))
    return U.audit_items(g, r, ["doc"], "grp", "alias", "at").select("doc", "grp", "lines", "reasons")


@query("g23_evidence_windows", f"""WITH {LINES}, p AS (SELECT doc_id, (ord - 1) // 40 AS page, ord FROM l), t AS (SELECT * FROM p WHERE ord % 17 = 5), s AS (SELECT doc_id, page, min(ord) AS a, max(ord) AS b FROM t GROUP BY ALL)
  SELECT p.doc_id, p.page, p.ord, p.ord % 17 = 5 AS target, true AS complete FROM p JOIN s USING (doc_id, page) WHERE p.ord BETWEEN a - 6 AND b + 6""")
def g23(spark, sf):
    p = documents_lines(spark, sf).select("doc_id", F.floor((F.col("ord") - 1) / 40).alias("page"), "ord")
    return U.evidence_windows(p.filter("ord % 17 = 5"), p, ["doc_id", "page"], "ord").select("doc_id", "page", "ord", "target", "complete")


@query("g27_restored", """WITH b AS (SELECT o_custkey AS doc, o_orderkey % 6 AS heading, o_orderkey % 3 AS unit, bool_and(o_totalprice > 20000) AS good FROM orders GROUP BY ALL),
  f AS (SELECT doc, heading, count(DISTINCT unit) AS n, min(unit) AS unit, bool_and(good) AS good FROM b GROUP BY ALL) SELECT doc, heading, CASE WHEN n = 1 AND good THEN unit END AS unit, CASE WHEN n <> 1 THEN 'SEVERAL' WHEN NOT good THEN 'DIFFERS' END AS reason FROM f""")
def g27(spark, sf):
    b = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 6).alias("heading"), (F.col("o_orderkey") % 3).alias("unit"), (F.col("o_totalprice") > 20000).alias("good"))
    return U.restored(b, ["doc"], "heading", "unit", F.lit(True), F.col("good"))


@query("g30_writeback", """WITH p AS (SELECT l_orderkey AS doc, l_partkey % 9 AS id FROM lineitem), w AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey % 9 AS id FROM lineitem), n AS (SELECT doc, id, count(*) AS n FROM p GROUP BY ALL)
  SELECT doc, id, CASE WHEN n IS NULL THEN 'MISSING' WHEN n > 1 THEN 'SEVERAL' ELSE 'OK' END AS state FROM w LEFT JOIN n USING (doc, id)""")
def g30(spark, sf):
    i = table(spark, sf, "lineitem")
    return U.writeback(i.select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 9).alias("id")), i.select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 9).alias("id")), ["doc"], "id")


@query("g33_group_answers", """WITH a AS (SELECT l_orderkey AS doc, l_returnflag AS run, l_linenumber AS line FROM lineitem), t AS (SELECT l_orderkey AS doc, l_returnflag AS run, l_linestatus AS heading, CASE WHEN l_orderkey % 11 = 0 AND l_linenumber = 3 THEN 2 ELSE l_linenumber END AS line,
  CASE WHEN l_orderkey % 13 = 0 THEN -l_linenumber ELSE l_linenumber END AS place FROM lineitem WHERE l_orderkey % 5 <> 0 AND NOT (l_orderkey % 7 = 0 AND l_linenumber = 2)),
  b AS (SELECT *, line <= lag(line) OVER (PARTITION BY doc, run ORDER BY place) AS back, count(*) OVER (PARTITION BY doc, run, heading) AS size FROM t), p AS (SELECT doc, run, count(*) AS n, count(DISTINCT line) AS own, coalesce(bool_or(back), false) AS back, max(size) AS size FROM b GROUP BY ALL),
  m AS (SELECT doc, run, count(*) AS asked, count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE t.doc = a.doc AND t.run = a.run AND t.line = a.line)) AS covered FROM a GROUP BY doc, run)
  SELECT doc, run, CASE WHEN n IS NULL THEN 'MISSING' WHEN covered < asked OR own > covered THEN 'UNCOVERED' WHEN n > own THEN 'REPEATED' WHEN back THEN 'ORDER' WHEN size > 3 THEN 'SIZE' ELSE 'OK' END AS verdict FROM m LEFT JOIN p USING (doc, run)""")
def g33(spark, sf):
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("heading"), F.col("l_linenumber").alias("line"))
    told = i.filter("doc % 5 <> 0 AND NOT (doc % 7 = 0 AND line = 2)").withColumn("at", F.when(F.col("doc") % 13 == 0, -F.col("line")).otherwise(F.col("line")))
    told = told.withColumn("line", F.when((F.col("doc") % 11 == 0) & (F.col("line") == 3), 2).otherwise(F.col("line")))
    return U.group_answers(told, i, ["doc"], "run", "heading", "line", "at", 3)


@query("ag19_observations", """SELECT l_suppkey, sum(l_linenumber) AS n, list(l_linenumber ORDER BY l_linenumber) AS seen FROM (SELECT l_suppkey, l_linenumber FROM lineitem) GROUP BY l_suppkey""")
def ag19(spark, sf):
    i = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("n"), F.array("l_linenumber").alias("seen"))
    return U.observations(i, ["l_suppkey"], ["n"], ["seen"])


@query("ag4_block_statistics", f"""WITH {LINES}, b AS (SELECT doc_id, (ord - 1) // 8 AS block, length(text) % 5 AS size, ord % 3 = 0 AS bold, length(text) AS chars FROM l), s AS (SELECT doc_id, block, size, sum(chars) AS c, sum(CASE WHEN bold THEN chars ELSE 0 END) AS b FROM b GROUP BY ALL)
  SELECT doc_id, block, arg_min(size, (-c, size)) AS size, sum(c)::BIGINT AS chars, CASE WHEN sum(c) > 0 THEN sum(b) / sum(c)::DOUBLE ELSE 0 END AS bold_share FROM s GROUP BY doc_id, block""")
def ag4(spark, sf):
    l = documents_lines(spark, sf).select("doc_id", F.floor((F.col("ord") - 1) / 8).alias("block"), (F.length("text") % 5).alias("size"), (F.col("ord") % 3 == 0).alias("bold"), F.length("text").alias("chars"))  # noqa: E741
    return U.block_statistics(l, ["doc_id", "block"], "size", "bold", "chars")


@query("j12_mapped_parts", """WITH f AS (SELECT l_orderkey AS fact, l_partkey AS old FROM lineitem), o AS (SELECT p_partkey AS old, count(DISTINCT p_size) AS n, min(p_size) AS place FROM part WHERE p_partkey % 4 <> 0 GROUP BY ALL)
  SELECT fact, count(*) AS parts, count(place) AS mapped, CASE WHEN count(place) = count(*) THEN 'MAPPED' WHEN count(place) > 0 THEN 'PARTLY' ELSE 'UNMAPPED' END AS state FROM f LEFT JOIN o USING (old) GROUP BY fact""")
def j12(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fact"), F.col("l_partkey").alias("old"))
    p = table(spark, sf, "part").filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("old"), F.col("p_size").alias("new"))
    return U.mapped_parts(f, p, ["fact"], "old", "new").drop("places")
