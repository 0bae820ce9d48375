"""Queries of the evidence tools, of coverage, and of windows with a cap on size."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafolio.operators import segments as S  # noqa: N812
from stratafolio.operators import tools as X  # noqa: N812
from stratafolio.plans.lines import LINES
from stratafolio.plans.registry import query
from stratafolio.plans.trees import H, headings
from stratafolio.session import table
from stratafolio.sources.lines import lines


@query("tool_page_layout", f"""WITH {LINES}, p AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM l WHERE (ord - 1) // 10 + 1 = 2) SELECT doc_id, ord, total, total > 6 AS has_more, CASE WHEN total > 6 THEN 6 END AS next_offset FROM p WHERE n > 2 AND n <= 6""")
def page_layout(spark, sf):
    l = lines(table(spark, sf, "documents")).withColumn("page", F.floor((F.col("ord") - 1) / 10) + 1)  # noqa: E741
    return X.page_layout(l, ["doc_id"], "ord", 2, offset=2, limit=4).select("doc_id", "ord", "total", "has_more", "next_offset")


@query("tool_line_facts", f"""WITH {LINES}, k AS (SELECT doc_id, lower(text) AS key, count(*) AS times, min(ord) AS first_at FROM l WHERE length(text) > 0 GROUP BY ALL), r AS (SELECT doc_id, ord, lower(text) AS key, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM l WHERE ord BETWEEN 3 AND 40)
  SELECT doc_id, ord, times, first_at, total > 24 AS has_more FROM r LEFT JOIN k USING (doc_id, key) WHERE n <= 24""")
def line_facts(spark, sf):
    l = lines(table(spark, sf, "documents")).withColumn("key", F.lower("text"))  # noqa: E741
    return X.facts_of_range(l, ["doc_id"], "ord", 3, 40, "key").select("doc_id", "ord", "times", "first_at", "has_more")


@query("tool_source_span", f"WITH {LINES} SELECT doc_id, ord, text FROM l WHERE ord IN (1, 4, 9)")
def source_span(spark, sf):
    return X.source_span(lines(table(spark, sf, "documents")), ["S0004", "S0001", "S0009", "S0004"]).select("doc_id", "ord", "text")


@query("ag8_size_histogram", f"""WITH {LINES}, b AS (SELECT doc_id, (ord - 1) // 30 AS page, length(text) % 7 AS size FROM l), s AS (SELECT doc_id, size, count(*) AS n FROM b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size DESC) AS r FROM s),
  t AS (SELECT doc_id, list(size || ':' || n ORDER BY r) AS sizes FROM r WHERE r <= 5 GROUP BY doc_id) SELECT doc_id, count(*) AS lines, count(DISTINCT page) AS pages, any_value(sizes) AS sizes FROM b JOIN t USING (doc_id) GROUP BY doc_id""")
def ag8(spark, sf):
    l = lines(table(spark, sf, "documents")).withColumn("page", F.floor((F.col("ord") - 1) / 30)).withColumn("size", F.length("text") % 7)  # noqa: E741
    return X.overview(l, ["doc_id"], "page", "size")


@query("so6_coverage_of_answers", """WITH a AS (SELECT DISTINCT o_custkey AS g, o_orderkey % 30 AS x FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_custkey AS g, o_orderkey % 30 AS x, x < lag(x) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS back FROM orders WHERE o_totalprice > 60000),
  t AS (SELECT g, x, count(*) AS n, bool_or(back) AS back FROM b GROUP BY ALL), m AS (SELECT coalesce(a.g, t.g) AS g, a.x AS asked, n, back FROM a FULL JOIN t ON a.g = t.g AND a.x = t.x),
  s AS (SELECT g, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (asked IS NULL) AS unexpected, count(*) FILTER (n > 1) AS repeated, NOT coalesce(bool_or(back), false) AS in_order FROM m GROUP BY g) SELECT *, missing = 0 AND unexpected = 0 AND repeated = 0 AND in_order AS equal FROM s""")
def so6(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), (F.col("o_orderkey") % 30).alias("x"), "o_orderkey", "o_orderstatus", "o_totalprice")
    return X.coverage(o.filter("o_orderstatus <> 'P'"), o.filter("o_totalprice > 60000"), ["g"], "x", "o_orderkey")


@query("j7_id_then_text", """WITH a AS (SELECT c_nationkey AS doc, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 40 END AS id, c_mktsegment || c_custkey % 9 AS t, c_custkey AS r FROM customer), b AS (SELECT s_nationkey AS doc, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 40 END AS id, 'BUILDING' || s_suppkey % 9 AS t, s_suppkey AS r FROM supplier),
  ai AS (SELECT doc, id, min(r) AS r FROM a WHERE id IS NOT NULL GROUP BY ALL HAVING count(*) = 1), bi AS (SELECT doc, id, min(r) AS r FROM b WHERE id IS NOT NULL GROUP BY ALL HAVING count(*) = 1), i AS (SELECT doc, ai.r AS left_row, bi.r AS right_row, 'id' AS how FROM ai JOIN bi USING (doc, id)),
  at AS (SELECT doc, t, min(r) AS r, min(id) AS id FROM a GROUP BY ALL HAVING count(*) = 1), bt AS (SELECT doc, t, min(r) AS r, min(id) AS id FROM b GROUP BY ALL HAVING count(*) = 1), x AS (SELECT doc, "at".r AS left_row, bt.r AS right_row, 'text' AS how FROM "at" JOIN bt USING (doc, t) WHERE "at".id IS NULL OR bt.id IS NULL)
  SELECT * FROM i UNION ALL SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc = x.doc AND i.left_row = x.left_row) AND NOT EXISTS (SELECT 1 FROM i WHERE i.doc = x.doc AND i.right_row = x.right_row)""".replace("  at AS", '  "at" AS'))
def j7(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 40).alias("id"), F.concat("c_mktsegment", F.col("c_custkey") % 9).alias("t"), F.col("c_custkey").alias("r"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("doc"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey") % 40).alias("id"), F.concat(F.lit("BUILDING"), F.col("s_suppkey") % 9).alias("t"), F.col("s_suppkey").alias("r"))
    return X.matched_by_id_or_text(a, b, ["doc"], "id", "t", "r")


@query("g25_verdict_states", """WITH f AS (SELECT user_id, event_type AS k, arg_min(CASE WHEN value > 60 THEN 'KEEP' WHEN value > 30 THEN 'EXCLUDE' ELSE 'HM' END, event_id) AS v FROM events WHERE value > 10 GROUP BY ALL), i AS (SELECT DISTINCT user_id, event_type AS k FROM events)
  SELECT i.user_id, i.k, CASE WHEN i.user_id % 9 = 0 THEN 'FAILED' WHEN v IS NULL THEN 'MISSING' WHEN v = 'KEEP' THEN 'KEPT' WHEN v = 'EXCLUDE' THEN 'EXCLUDED' ELSE 'UNSURE' END AS state FROM i LEFT JOIN f USING (user_id, k)""")
def g25(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("k"), "value", "event_id")
    said = e.filter("value > 10").withColumn("verdict", F.when(F.col("value") > 60, "KEEP").when(F.col("value") > 30, "EXCLUDE").otherwise("HM"))
    return X.agreement(said, e.select("user_id", "k").distinct(), ["user_id"], "k", "event_id", F.col("user_id") % 9 == 0)


@query("w20_depths")
def w20(spark, sf):
    return S.depths(S.block_cosine(lines(table(spark, sf, "documents")), 3), ["doc_id"], "gap", "cosine")


@query("w16_capped_windows")
def w16(spark, sf):
    l = lines(table(spark, sf, "documents")).select("doc_id", "ord", F.octet_length("text").alias("bytes"))  # noqa: E741
    return S.capped_windows(l, ["doc_id"], "ord", "bytes", most=10, most_size=900).select("doc_id", "ord", "window")


@query("w14_stack_paths", f"""WITH RECURSIVE {H}, o AS (SELECT doc, ord, CASE WHEN id % 9 > 0 THEN level END AS level, 'n' || id % 6 AS name, row_number() OVER (PARTITION BY doc ORDER BY ord) AS r FROM n),
  f AS (SELECT doc, r, ord, '' AS path, true AS certain, CASE WHEN level IS NULL THEN [] ELSE [level] END AS lv, CASE WHEN level IS NULL THEN [] ELSE [name] END AS nm, level IS NOT NULL AS ok FROM o WHERE r = 1
    UNION ALL SELECT o.doc, o.r, o.ord, array_to_string(f.nm, ' > '), f.ok, CASE WHEN o.level IS NULL THEN f.lv ELSE list_append(list_filter(f.lv, lambda x: x < o.level), o.level) END,
    CASE WHEN o.level IS NULL THEN f.nm ELSE list_append(f.nm[1:len(list_filter(f.lv, lambda x: x < o.level))], o.name) END, o.level IS NOT NULL FROM f JOIN o ON o.doc = f.doc AND o.r = f.r + 1)
  SELECT doc, ord, path, certain FROM f""")
def w14(spark, sf):
    h = headings(spark, sf).select("doc", "ord", F.lit(True).alias("heading"), F.when(F.col("id") % 9 > 0, F.col("level")).alias("level"), F.concat(F.lit("n"), F.col("id") % 6).alias("name"))
    return S.stack_paths(h, ["doc"], "ord", "heading", "level", "name").select("doc", "ord", "path", "certain")
