"""Queries of boxes: the sides of parts and line items stand for boxes on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafolio.operators import geometry as G  # noqa: N812
from stratafolio.plans.lines import LINES
from stratafolio.plans.registry import query
from stratafolio.session import table
from stratafolio.sources.lines import lines

#: Boxes on pages of ten line items, in SQL that both engines read; the second view is a little off.
BOXES = """SELECT CAST(floor(l_orderkey / 10) AS BIGINT) AS page, l_orderkey * 10 + l_linenumber AS id, (l_partkey % 40) * 10e0 + {off} AS "left", (l_suppkey % 50) * 8e0 AS top, (l_partkey % 40) * 10e0 + 20 + l_quantity AS "right", (l_suppkey % 50) * 8e0 + 8 + {off} AS bottom FROM {items}"""


def boxes(spark, sf, off):
    sql = BOXES.replace('"', "`").replace("{off}", str(off))
    return spark.sql(sql, items=table(spark, sf, "lineitem")).select("page", "id", F.struct("left", "top", "right", "bottom").alias("box"), "left", "top", "right", "bottom")


def sql_boxes(off):
    return BOXES.format(off=off, items="lineitem")


@query("j8_matched_boxes")
def j8(spark, sf):
    return G.matched_boxes(boxes(spark, sf, 0), boxes(spark, sf, 2), ["page"], "id", "box").select("page", "left_id", "right_id", F.round("share", 6).alias("share"))


@query("f_box_relation", f"""WITH b AS ({sql_boxes(0)}), p AS (SELECT a.id, b.id AS other, a."left" AS l, a.top AS t, a.bottom AS d, b."left" AS l2, b.top AS t2, b.bottom AS d2 FROM b a JOIN b ON a.page = b.page AND a.id // 10 = b.id // 10 AND a.id + 1 = b.id)
  SELECT id, other, abs(d - d2) <= 2 AS same_baseline, l2 - l AS right_by, t2 - t AS down_by, greatest(0.0, least(d, d2) - greatest(t, t2)) / least(d - t, d2 - t2) AS overlap FROM p""")
def box_relation(spark, sf):
    b = boxes(spark, sf, 0)
    pairs = b.select((F.col("id") + 1).alias("other"), "id", F.col("box").alias("a")).join(b.select(F.col("id").alias("other"), F.col("box").alias("b")), "other")
    return pairs.filter(F.floor(F.col("id") / 10) == F.floor(F.col("other") / 10)).withColumn("r", G.relation("a", "b")).select("id", "other", "r.*")


@query("w9_layout_blocks", f"""WITH {LINES}, x AS (SELECT doc_id, ord, text, (length(text) % 5) * 8.0 AS "left", ord * 12.0 + (length(text) % 4) * 3 AS top, 10 + (length(text) % 3) AS size, length(text) % 11 = 0 AS bold FROM l),
  b AS (SELECT *, lag(ord) OVER w IS NULL OR top - lag(top) OVER w > 16 OR abs("left" - lag("left") OVER w) > 24 OR greatest(size, lag(size) OVER w) > 1.1 * least(size, lag(size) OVER w) OR bold IS DISTINCT FROM lag(bold) OVER w
    OR coalesce(regexp_matches(lag(text) OVER w, '[.!?:;]\\s*$'), false) OR length(text) > 130 OR coalesce(length(lag(text) OVER w) > 130, false) AS broken FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
  r AS (SELECT *, sum(broken::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM b), c AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY ord) - 1) % 4 = 0 AS cut FROM r) SELECT doc_id, ord, sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS block FROM c""")
def w9(spark, sf):
    n = F.length("text")
    l = lines(table(spark, sf, "documents")).withColumns({"left": (n % 5) * 8.0, "top": F.col("ord") * 12.0 + (n % 4) * 3, "size": 10 + n % 3, "bold": n % 11 == 0})  # noqa: E741
    return G.layout_blocks(l, ["doc_id"], "ord", text="text", left="left", top="top", size="size", face=["bold"], pitch=F.lit(16)).select("doc_id", "ord", "block")


@query("g17_blank_bands", f"""WITH {LINES}, b AS (SELECT doc_id, ord, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM l WHERE length(text) % 3 <> 0) SELECT doc_id, min(ord) AS first, max(ord) AS last, count(*) AS rows FROM b GROUP BY doc_id, run HAVING count(*) >= 3""")
def g17(spark, sf):
    return G.blank_bands(lines(table(spark, sf, "documents")), ["doc_id"], "ord", F.when(F.length("text") % 3 == 0, 1).otherwise(0), 3)


@query("g1_visual_lines")
def g1(spark, sf):
    b = boxes(spark, sf, 0).withColumn("baseline", F.col("bottom") - 1).withColumn("scale", F.col("right") - F.col("left"))
    return G.visual_lines(b.select("page", "id", "baseline", "top", "bottom", "scale"), ["page"], "id", baseline="baseline", top="top", bottom="bottom", scale="scale").select("page", "id", "line")


@query("g2_corridor_cuts", f"""WITH b AS (SELECT page, (top // 8)::BIGINT AS row, "left" AS l, "right" AS r, id FROM ({sql_boxes(0)})), g AS (SELECT *, lead(l) OVER w AS "to", max(r) OVER (PARTITION BY page, row ORDER BY l RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "from" FROM b WINDOW w AS (PARTITION BY page, row ORDER BY l)),
  wide AS (SELECT page, row, "from", "to" FROM g WHERE "to" - "from" >= 3 * 5), near AS (SELECT *, unnest([row - 2, row - 1, row + 1, row + 2]) AS other FROM wide),
  s AS (SELECT n.page, n.row, "from", "to", n.other, greatest("from", max(b.r) FILTER (b.l < ("from" + "to") / 2)) AS a, least("to", min(b.l) FILTER (b.l >= ("from" + "to") / 2)) AS z, count(*) FILTER (b.l < ("from" + "to") / 2) AS n1, count(*) FILTER (b.l >= ("from" + "to") / 2) AS n2
    FROM near n JOIN b ON b.page = n.page AND b.row = n.other GROUP BY n.page, n.row, "from", "to", n.other) SELECT page, row, "from", "to" FROM s GROUP BY page, row, "from", "to" HAVING bool_or(z - a >= ("to" - "from") / 2 AND n1 > 0 AND n2 > 0)""")
def g2(spark, sf):
    b = boxes(spark, sf, 0).withColumn("row", F.floor(F.col("top") / 8))
    return G.corridor_cuts(b, ["page"], "row", "left", "right", F.lit(5)).select("page", "row", "from", "to")


@query("g18_line_facts", f"""WITH {LINES}, b AS (SELECT doc_id, (ord - 1) // 20 AS page, ord, text, (length(text) % 7) * 5.0 AS lo, 100.0 + length(text) AS hi, lower(text) AS key FROM l)
  SELECT doc_id, page, ord, lo - min(lo) OVER p AS left_margin, max(hi) OVER p - hi AS right_margin, round((lo + hi) / 2 - (min(lo) OVER p + max(hi) OVER p) / 2, 6) AS off_centre, length(text) AS chars, len(regexp_extract_all(text, '\\S+')) AS words,
  CASE WHEN length(key) > 0 THEN count(*) OVER (PARTITION BY doc_id, key) - 1 ELSE 0 END AS elsewhere FROM b WINDOW p AS (PARTITION BY doc_id, page)""")
def g18(spark, sf):
    l = lines(table(spark, sf, "documents")).select("doc_id", F.floor((F.col("ord") - 1) / 20).alias("page"), "ord", "text", ((F.length("text") % 7) * 5.0).alias("lo"), (F.length("text") + 100.0).alias("hi"), F.lower("text").alias("key"))  # noqa: E741
    out = G.line_facts(l, ["doc_id", "page"], ["doc_id"], left="lo", right="hi", text="text", key="key")
    return out.select("doc_id", "page", "ord", "left_margin", "right_margin", F.round("off_centre", 6).alias("off_centre"), "chars", "words", "elsewhere")
