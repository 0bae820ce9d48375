"""Queries of the tree operators. A customer's orders are headings; parents and levels come from their keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratafolio.operators import trees as T
from stratafolio.plans.registry import query
from stratafolio.session import table

H = """h AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, o_orderkey AS id FROM orders),
n AS (SELECT *, CASE WHEN ord = 1 OR id % 7 = 0 THEN 0 WHEN id % 13 = 0 THEN -1 WHEN id % 17 = 0 THEN ord + 2 ELSE ord - 1 - id % 3 END AS parent, 1 + (id * 7 % 11) % 5 AS level FROM h)"""


def headings(spark, sf):
    ord_ = F.row_number().over(Window.partitionBy("doc").orderBy("id")).cast("long")
    h = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("id")).withColumn("ord", ord_)
    parent = F.when((F.col("ord") == 1) | (F.col("id") % 7 == 0), 0).when(F.col("id") % 13 == 0, -1).when(F.col("id") % 17 == 0, F.col("ord") + 2).otherwise(F.col("ord") - 1 - F.col("id") % 3)
    return h.withColumn("parent", parent).withColumn("level", 1 + F.col("id") * 7 % 11 % 5)


@query("t1_levels", f"""WITH RECURSIVE {H}, e AS (SELECT c.*, CASE WHEN c.parent > 0 AND c.parent < c.ord AND p.parent <> -1 THEN p.ord END AS up FROM n c LEFT JOIN n p ON p.doc = c.doc AND p.ord = c.parent),
  r AS (SELECT doc, ord, 1 AS level FROM e WHERE parent = 0 UNION ALL SELECT e.doc, e.ord, least(r.level + 1, 9) FROM e JOIN r ON e.doc = r.doc AND e.up = r.ord WHERE e.parent <> 0)
  SELECT e.doc, e.ord, CASE WHEN parent = -1 THEN 'outside' WHEN r.level IS NULL THEN 'unresolved' WHEN parent = 0 THEN 'root' ELSE 'parent' END AS resolution, r.level FROM e LEFT JOIN r ON e.doc = r.doc AND e.ord = r.ord""")
def t1(spark, sf):
    return T.levels(headings(spark, sf).select("doc", "ord", "parent"), ["doc"], "ord", "parent").select("doc", "ord", "resolution", "level")


@query("t6_parents", f"WITH {H} SELECT c.doc, c.ord, max(p.ord) AS parent FROM n c LEFT JOIN n p ON p.doc = c.doc AND p.ord < c.ord AND p.level < c.level GROUP BY c.doc, c.ord")
def t6(spark, sf):
    return T.parents(headings(spark, sf), ["doc"], "ord", "level").select("doc", "ord", F.col("parent"))


@query("t7_strict_parents", f"""WITH {H}, p AS (SELECT c.doc, c.ord, c.level, max(p.ord) FILTER (p.level = c.level - 1) AS above, coalesce(max(p.ord) FILTER (p.level < c.level - 1), 0) AS cleared FROM n c LEFT JOIN n p ON p.doc = c.doc AND p.ord < c.ord GROUP BY ALL)
  SELECT doc, ord, CASE WHEN above > cleared THEN above END AS parent, CASE WHEN level = 1 THEN 'root' WHEN above > cleared THEN 'parent' ELSE 'unresolved' END AS status FROM p""")
def t7(spark, sf):
    return T.strict_parents(headings(spark, sf), ["doc"], "ord", "level").select("doc", "ord", "parent", "status")


@query("t8_prefix_parents", f"""WITH {H}, p AS (SELECT doc, ord, CASE id % 3 WHEN 0 THEN [id % 4] WHEN 1 THEN [id % 4, id % 2] ELSE [id % 4, id % 2, id % 5] END AS path FROM n)
  SELECT c.doc, c.ord, max(p.ord) AS parent FROM p c LEFT JOIN p ON p.doc = c.doc AND p.ord < c.ord AND len(c.path) > 1 AND p.path = c.path[1:len(c.path) - 1] GROUP BY c.doc, c.ord""")
def t8(spark, sf):
    a, b, c = F.col("id") % 4, F.col("id") % 2, F.col("id") % 5
    path = F.when(F.col("id") % 3 == 0, F.array(a)).when(F.col("id") % 3 == 1, F.array(a, b)).otherwise(F.array(a, b, c))
    return T.prefix_parents(headings(spark, sf).select("doc", "ord", path.alias("path")), ["doc"], "ord", "path").select("doc", "ord", "parent")


@query("t9_chains", f"""WITH RECURSIVE {H}, p AS (SELECT c.doc, c.ord, c.id::VARCHAR AS name, max(p.ord) AS parent FROM n c LEFT JOIN n p ON p.doc = c.doc AND p.ord < c.ord AND p.level < c.level GROUP BY ALL),
  r AS (SELECT doc, ord, name AS chain FROM p WHERE parent IS NULL UNION ALL SELECT p.doc, p.ord, r.chain || ' > ' || p.name FROM p JOIN r ON p.doc = r.doc AND p.parent = r.ord) SELECT * FROM r""")
def t9(spark, sf):
    return T.chains(headings(spark, sf).withColumn("name", F.col("id").cast("string")), ["doc"], "ord", "level", "name").select("doc", "ord", "chain")


@query("t11_section_ends", f'WITH {H} SELECT c.doc, c.ord, min(p.ord) AS "end" FROM n c LEFT JOIN n p ON p.doc = c.doc AND p.ord > c.ord AND p.level <= c.level GROUP BY c.doc, c.ord')
def t11(spark, sf):
    return T.section_ends(headings(spark, sf), ["doc"], "ord", "level").select("doc", "ord", "end")


@query("t5_sections", f"""WITH {H}, s AS (SELECT c.doc, c.ord, min(p.ord) AS e FROM n c LEFT JOIN n p ON p.doc = c.doc AND p.ord > c.ord AND p.level <= c.level WHERE c.level <= 3 GROUP BY c.doc, c.ord)
  SELECT s.doc, s.ord AS section, count(*) AS units, min(u.id) AS first_unit FROM s JOIN n u ON u.doc = s.doc AND u.ord >= s.ord AND (s.e IS NULL OR u.ord < s.e) GROUP BY s.doc, s.ord""")
def t5(spark, sf):
    h = headings(spark, sf)
    s = T.section_ends(h, ["doc"], "ord", "level").filter("level <= 3").select("doc", F.col("ord").alias("section"), F.col("end").alias("stop"))
    inside = s.join(h.select("doc", "ord", "id"), "doc").filter("ord >= section AND (stop IS NULL OR ord < stop)")
    return inside.groupBy("doc", "section").agg(F.count(F.lit(1)).alias("units"), F.min("id").alias("first_unit"))
