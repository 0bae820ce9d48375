"""Queries of decisions, projections and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafolio.operators import decisions as D
from stratafolio.plans.lines import LINES
from stratafolio.plans.registry import query
from stratafolio.plans.scalars import H as HEADINGS
from stratafolio.plans.scalars import headings as texts
from stratafolio.plans.trees import H, headings
from stratafolio.plans.windows import items, with_items
from stratafolio.session import table
from stratafolio.sources.lines import lines


@query("pr4_projection", """SELECT c_custkey, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, c_name) AS name, coalesce(s_nationkey, c_nationkey) AS nation FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def pr4(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    o = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"), F.col("s_nationkey").alias("nation"))
    return D.projected(c, o, ["c_custkey"], ["name", "nation"])


@query("pr7_stats", "SELECT count(*) AS headings, count(*) FILTER (parent = 0) AS roots, count(*) FILTER (parent = -1) AS outside, max(level) AS deepest FROM (WITH " + H + " SELECT * FROM n)")
def pr7(spark, sf):
    return headings(spark, sf).agg(F.count(F.lit(1)).alias("headings"), F.count_if(F.col("parent") == 0).alias("roots"), F.count_if(F.col("parent") == -1).alias("outside"), F.max("level").alias("deepest"))


@query("fv4_boundaries", rf"""WITH {HEADINGS}, c AS (SELECT doc, ord, text, unnest(range(0, length(text) + 1)) AS pos FROM h), k AS (SELECT doc, ord, pos, length(text) AS n, CASE WHEN regexp_matches(substr(text, pos, 1), '\pN') THEN 1 WHEN regexp_matches(substr(text, pos, 1), '\pL') THEN 2 ELSE 0 END AS a,
  CASE WHEN regexp_matches(substr(text, pos + 1, 1), '\pN') THEN 1 WHEN regexp_matches(substr(text, pos + 1, 1), '\pL') THEN 2 ELSE 0 END AS b FROM c) SELECT doc, ord, count(*) AS edges, sum(pos)::BIGINT AS total FROM k WHERE pos = 0 OR pos = n OR a <> b OR b = 0 GROUP BY doc, ord""")
def fv4(spark, sf):
    e = texts(spark, sf).select("doc", "ord", F.explode(D.boundaries(F.col("text"))).alias("place"))
    return e.groupBy("doc", "ord").agg(F.count(F.lit(1)).alias("edges"), F.sum("place").alias("total"))


@query("g9_worst_status", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R' AND l_quantity > 45) THEN 'CONFLICT' WHEN bool_and(l_linestatus = 'O') THEN 'CORROBORATED' ELSE 'UNVERIFIED' END AS status, count(*) AS parts FROM lineitem GROUP BY l_orderkey")
def g9(spark, sf):
    return D.worst_status(table(spark, sf, "lineitem"), ["l_orderkey"], (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), F.col("l_linestatus") == "O")


@query("t2_primary", with_items("""WITH k AS (SELECT doc, ord, coalesce(CASE WHEN num % 2 = 0 THEN 'h' || num END, 'p' || l_suppkey) AS node_key FROM items) SELECT doc, ord, node_key, row_number() OVER (PARTITION BY doc, node_key ORDER BY ord) = 1 AS "primary" FROM k"""))
def t2(spark, sf):
    hint = F.when(F.col("num") % 2 == 0, F.concat(F.lit("h"), F.col("num").cast("string")))
    return D.primary(items(spark, sf).select("doc", "ord", "num", "l_suppkey"), ["doc"], hint, F.concat(F.lit("p"), F.col("l_suppkey").cast("string")), "ord").select("doc", "ord", "node_key", "primary")


@query("a22_shifted_subtree", f"""WITH {H}, r AS (SELECT n.*, max(CASE WHEN ord = 3 THEN level END) OVER (PARTITION BY doc) AS root FROM n), s AS (SELECT *, ord >= 3 AND max(CASE WHEN ord > 3 AND level <= root THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord) = 0 AS inside FROM r),
  f AS (SELECT *, bool_and(NOT inside OR level + 1 - 2 * (doc % 2) BETWEEN 1 AND 9) OVER (PARTITION BY doc) AS accepted FROM s) SELECT doc, ord, accepted, CASE WHEN inside AND accepted THEN level + 1 - 2 * (doc % 2) ELSE level END AS new_level FROM f""")
def a22(spark, sf):
    h = headings(spark, sf).withColumn("at", F.lit(3)).withColumn("delta", 1 - 2 * (F.col("doc") % 2))
    return D.shifted(h, ["doc"], "ord", "level", "at", "delta").select("doc", "ord", "accepted", "new_level")


@query("g13_routed", """WITH f AS (SELECT event_id, user_id AS doc, event_type AS label FROM events), n AS (SELECT user_id AS doc, CASE event_id % 4 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' ELSE 'x' END AS label, count(*) AS n, min(event_id) AS target FROM events WHERE event_id % 50 < 4 GROUP BY ALL)
  SELECT event_id, CASE WHEN n = 1 THEN 'ROUTED' ELSE 'UNRESOLVED' END AS status, CASE WHEN n = 1 THEN target END AS target FROM f LEFT JOIN n USING (doc, label)""")
def g13(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "doc")
    k = F.col("event_id") % 4
    name = F.when(k == 0, "click").when(k == 1, "view").when(k == 2, "error").otherwise("x")
    return D.routed(e.select("event_id", "doc", F.col("event_type").alias("label")), e.filter("event_id % 50 < 4").select("doc", name.alias("name"), F.col("event_id").alias("target")), ["doc"], "label").select("event_id", "status", "target")


@query("d2_two_line", f"""WITH {LINES}, m AS (SELECT doc_id, ord, length(text) < 60 AND coalesce(lead(length(text) < 200) OVER (PARTITION BY doc_id ORDER BY ord), false) AS joins FROM l), f AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id ORDER BY ord), false) AS follows FROM m),
  r AS (SELECT *, sum(CASE WHEN follows THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY ord) AS k FROM r)
  SELECT doc_id, ord, CASE WHEN k % 2 = 1 AND joins THEN 'head' WHEN k % 2 = 0 AND follows THEN 'consumed' ELSE 'plain' END AS role FROM p""")
def d2(spark, sf):
    return D.two_line(lines(table(spark, sf, "documents")), ["doc_id"], "ord", F.length("text") < 60, F.length("text") < 200).select("doc_id", "ord", "role")


PAYLOAD = r"\d+/\d+|Bình thường"


@query("d3_split_body", rf"""WITH {HEADINGS}, p AS (SELECT *, CASE WHEN regexp_matches(text, '{PAYLOAD}') THEN instr(text, regexp_extract(text, '{PAYLOAD}')) ELSE 0 END AS a, instr(text, ':') AS b FROM h), c AS (SELECT *, CASE WHEN a > 1 AND b > 1 THEN least(a, b) WHEN a > 1 THEN a WHEN b > 1 THEN b END AS cut FROM p)
  SELECT doc, ord, regexp_replace(CASE WHEN cut IS NULL THEN text ELSE substr(text, 1, cut - 1) END, '^[ .:]+|[ .:]+$', '', 'g') AS heading, CASE WHEN cut IS NOT NULL THEN regexp_replace(substr(text, cut), '^[ :]+|[ :]+$', '', 'g') END AS body FROM c""")
def d3(spark, sf):
    return texts(spark, sf).withColumn("s", D.split_body(F.col("text"), PAYLOAD)).select("doc", "ord", "s.heading", "s.body")


@query("a14_interval_parts", with_items("""WITH e AS (SELECT doc, num AS pos, 1 AS d FROM items UNION ALL SELECT doc, num + l_quantity::INT % 4 + 1, -1 FROM items), s AS (SELECT doc, pos AS a, sum(d) AS d FROM e GROUP BY doc, pos),
  p AS (SELECT doc, a, sum(d) OVER w AS depth, lead(a) OVER w AS z FROM s WINDOW w AS (PARTITION BY doc ORDER BY a)) SELECT doc, a AS start, z AS "end", depth::BIGINT AS depth FROM p WHERE depth > 0 AND z IS NOT NULL"""))
def a14(spark, sf):
    i = items(spark, sf).select("doc", F.col("num").alias("a"), (F.col("num") + F.col("l_quantity").cast("int") % 4 + 1).alias("z"))
    return D.interval_parts(i, ["doc"], "a", "z")


@query("w24_style_rank", """WITH s AS (SELECT o_custkey, o_orderpriority AS style, count(*) AS lines FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY style) AS rank FROM s) SELECT o_orderkey, rank, lines FROM orders JOIN r ON orders.o_custkey = r.o_custkey AND o_orderpriority = style""")
def w24(spark, sf):
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    inner = Window.partitionBy("o_custkey", "o_orderpriority")
    return o.select("o_orderkey", F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("rank"), F.count(F.lit(1)).over(inner).alias("lines"))


@query("g12_centred_run", """WITH p AS (SELECT user_id, min(value) AS low, max(value) AS high FROM events GROUP BY user_id), c AS (SELECT e.user_id, event_id, abs(value - (low + high) / 2) <= 60 AS centred FROM events e JOIN p USING (user_id)),
  r AS (SELECT *, sum((NOT centred)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS broken FROM c) SELECT user_id, count(*) AS lines FROM r WHERE broken = 0 GROUP BY user_id HAVING count(*) >= 2""")
def g12(spark, sf):
    from pyspark.sql import Window

    page = Window.partitionBy("user_id")
    centred = F.abs(F.col("value") - (F.min("value").over(page) + F.max("value").over(page)) / 2) <= 60
    c = table(spark, sf, "events").select("user_id", "event_id", centred.alias("centred"))
    run = c.withColumn("broken", F.sum((~F.col("centred")).cast("int")).over(Window.partitionBy("user_id").orderBy("event_id"))).filter("broken = 0")
    return run.groupBy("user_id").agg(F.count(F.lit(1)).alias("lines")).filter("lines >= 2")
