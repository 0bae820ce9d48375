"""Queries of the validators; accepted rows have a null reason."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafolio.operators import validators as V
from stratafolio.plans.registry import query
from stratafolio.plans.trees import H, headings
from stratafolio.plans.windows import items, with_items
from stratafolio.session import table


@query("fv1_span", "SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber - 1 >= 0 AND l_quantity::INT > l_linenumber - 1 AND l_quantity::INT <= 40 AS valid FROM lineitem")
def fv1(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") - 1).alias("a"), F.col("l_quantity").cast("int").alias("b"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", V.span_valid("a", "b", F.lit(40)).alias("valid"))


@query("fv2_catalog", with_items("""WITH c AS (SELECT doc, ord, CASE WHEN ord % 6 = 0 THEN '' ELSE num::VARCHAR END AS id, num AS a, l_quantity::INT AS b FROM items), n AS (SELECT *, count(*) OVER (PARTITION BY doc, id) AS n FROM c)
  SELECT * FROM (SELECT doc, ord, CASE WHEN id = '' THEN 'EMPTY_ID' WHEN n > 1 THEN 'DUPLICATE_ID' WHEN NOT (a >= 0 AND b > a AND b <= 48) THEN 'INVALID_SPAN' END AS reason FROM n) WHERE reason IS NOT NULL"""))
def fv2(spark, sf):
    df = items(spark, sf).select("doc", "ord", F.when(F.col("ord") % 6 == 0, "").otherwise(F.col("num").cast("string")).alias("id"), F.col("num").alias("a"), F.col("l_quantity").cast("int").alias("b"))
    return V.catalog_faults(df, ["doc"], "id", F.lit(48), "a", "b").select("doc", "ord", "reason")


@query("fv5_first_reason", """SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'TOO_SMALL' WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderpriority LIKE '5%' THEN 'LOW' END AS reason FROM orders""")
def fv5(spark, sf):
    rules = [("TOO_SMALL", F.col("o_totalprice") < 1000), ("PENDING", F.col("o_orderstatus") == "P"), ("LOW", F.col("o_orderpriority").startswith("5"))]
    return V.first_reason(table(spark, sf, "orders"), rules).select("o_orderkey", "reason")


@query("fv7_relations", """WITH e AS (SELECT DISTINCT user_id AS doc, event_id % 9 AS parent, event_id % 12 AS child FROM events), k AS (SELECT DISTINCT user_id AS doc, event_id % 11 AS node FROM events),
  n AS (SELECT *, count(*) OVER (PARTITION BY doc, child) AS parents FROM e) SELECT doc, parent, child, CASE WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.doc = n.doc AND node = parent) OR NOT EXISTS (SELECT 1 FROM k WHERE k.doc = n.doc AND node = child) THEN 'ENDPOINT_MISSING'
  WHEN parent = child THEN 'OWN_PARENT' WHEN parents > 1 THEN 'SEVERAL_PARENTS' END AS reason FROM n""")
def fv7(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc"), "event_id")
    nodes = e.select("doc", (F.col("event_id") % 11).alias("node")).distinct()
    return V.relations(e.select("doc", (F.col("event_id") % 9).alias("parent"), (F.col("event_id") % 12).alias("child")), nodes, ["doc"])


@query("fv8_parent_admissible", f"""WITH {H} SELECT c.doc, c.ord, CASE WHEN c.parent IN (0, -1) THEN 'kept' WHEN p.ord IS NULL OR p.ord >= c.ord THEN 'removed' ELSE 'kept' END AS hint FROM n c LEFT JOIN n p ON p.doc = c.doc AND p.ord = c.parent""")
def fv8(spark, sf):
    n = headings(spark, sf)
    p = n.select("doc", F.col("ord").alias("parent"), F.lit(True).alias("known"))
    ok = F.col("parent").isin(0, -1) | (F.col("known") & (F.col("parent") < F.col("ord")))
    return n.join(p, ["doc", "parent"], "left").select("doc", "ord", F.when(ok, "kept").otherwise("removed").alias("hint"))


@query("fv9_sibling_conflicts", f"""WITH {H} SELECT doc, ord, coalesce(lag(level) OVER w = level AND lag(parent) OVER w <> parent, false) OR coalesce(lead(level) OVER w = level AND lead(parent) OVER w <> parent, false) AS held FROM n WINDOW w AS (PARTITION BY doc ORDER BY ord)""")
def fv9(spark, sf):
    return V.sibling_conflicts(headings(spark, sf), ["doc"], "ord", F.col("level"), "parent").select("doc", "ord", "held")


@query("fv10_output_policy", "SELECT doc_id, CASE WHEN length(text) < 20 THEN 'EMPTY' WHEN lang <> 'en' THEN 'STATUS' END AS reason FROM documents")
def fv10(spark, sf):
    return V.first_reason(table(spark, sf, "documents"), [("EMPTY", F.length("text") < 20), ("STATUS", F.col("lang") != "en")]).select("doc_id", "reason")


@query("fv11_entities", """WITH p AS (SELECT event_id, user_id % 120 AS source_id, event_type AS type, (event_id % 40)::INT AS start, (event_id % 40 + value)::INT AS stop FROM events), u AS (SELECT c_custkey AS source_id, 60 AS len FROM customer WHERE c_custkey < 100),
  j AS (SELECT p.*, len, coalesce(len IS NOT NULL AND type IN ('click', 'view') AND start >= 0 AND stop > start AND stop <= len, false) AS sound FROM p LEFT JOIN u USING (source_id)), a AS (SELECT *, row_number() OVER (PARTITION BY source_id, type, start, sound ORDER BY event_id) > 1 AND sound AS again FROM j)
  SELECT event_id, CASE WHEN len IS NULL THEN 'UNKNOWN_SOURCE' WHEN type NOT IN ('click', 'view') THEN 'TYPE_UNKNOWN' WHEN NOT (start >= 0 AND stop > start AND stop <= len) THEN 'SPAN_OUTSIDE_TEXT' WHEN again THEN 'DUPLICATE' END AS reason FROM a""")
def fv11(spark, sf):
    e = table(spark, sf, "events")
    p = e.select("event_id", (F.col("user_id") % 120).alias("source_id"), F.col("event_type").alias("type"), (F.col("event_id") % 40).cast("int").alias("start"), F.rint(F.col("event_id") % 40 + F.col("value")).cast("int").alias("end"))
    u = table(spark, sf, "customer").filter("c_custkey < 100").select(F.col("c_custkey").alias("source_id"), F.lit(60).alias("length"))
    return V.checked(p, u, ["click", "view"], ["source_id", "type", "start"], ["event_id"]).select("event_id", "reason")


@query("fv13_flags", """SELECT o_custkey, count(DISTINCT o_orderpriority) > 1 AS cross_source, count(*) > 1 AS multiple_units, bool_or(o_orderstatus = 'P') AS uncertain, bool_and(o_totalprice > 0) AS complete FROM orders GROUP BY o_custkey""")
def fv13(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        (F.countDistinct("o_orderpriority") > 1).alias("cross_source"), (F.count(F.lit(1)) > 1).alias("multiple_units"), F.bool_or(F.col("o_orderstatus") == "P").alias("uncertain"), F.bool_and(F.col("o_totalprice") > 0).alias("complete")
    )


@query("g10_decision_runs", """WITH d AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS size FROM d GROUP BY user_id, g""")
def g10(spark, sf):
    d = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", "SPLIT").otherwise("JOIN").alias("decision"))
    return V.decision_runs(d, ["user_id"], "event_id", "decision")


@query("g24_block_dedup", """SELECT l_orderkey, l_suppkey, count(DISTINCT l_partkey) > 1 AS differs, min(l_linenumber) AS ordinal FROM lineitem GROUP BY ALL""")
def g24(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg((F.countDistinct("l_partkey") > 1).alias("differs"), F.min("l_linenumber").alias("ordinal"))
