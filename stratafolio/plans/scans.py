"""Queries of scans: line items stand for pages and their images, names of parts for two readings of a line."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafolio.operators import scans as S  # noqa: N812
from stratafolio.plans.registry import query
from stratafolio.session import table


@query("sc15_source_kind", """WITH p AS (SELECT l_orderkey AS doc, l_quantity >= 0.6 * 50 AND l_partkey % 100 >= 0.6 * 100 AS page, l_suppkey AS chars FROM lineitem), d AS (SELECT doc, count(*) FILTER (page) AS n, sum(chars)::BIGINT AS chars FROM p GROUP BY doc) SELECT doc, CASE WHEN n = 0 THEN 'native' WHEN chars < 200 * n THEN 'image_only' ELSE 'mixed' END AS kind FROM d""")
def sc15(spark, sf):
    i = table(spark, sf, "lineitem").withColumn("page", S.covers_page(F.col("l_quantity"), F.col("l_partkey") % 100, F.lit(50), F.lit(100)))
    d = i.groupBy(F.col("l_orderkey").alias("doc")).agg(F.count_if("page").alias("n"), F.sum("l_suppkey").alias("chars"))
    return d.select("doc", S.source_kind(F.col("n"), F.col("chars")).alias("kind"))


@query("a17_view_differences", """SELECT p_partkey AS pair_id, p_name AS "left", CASE WHEN p_partkey % 2 = 0 THEN 'big ' || p_type ELSE '' END AS "right" FROM part""")
def a17(spark, sf):
    """Readings that share their first word only."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("pair_id"), F.split(F.concat(F.lit("the "), "p_name"), " ").alias("left"), F.split(F.concat(F.lit("the"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" big "), "p_type")).otherwise("")), " ").alias("right"))
    return S.differing_views(p)


@query("ag10_scored_headings")
def ag10(spark, sf):
    """Each order's items as labelled headings; every third is left out, every fifth stands a page on, and the others keep their page."""
    i = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Điều "), "l_linenumber").alias("label"), F.floor(F.col("l_linenumber") / 3).cast("int").alias("page"), F.concat(F.lit("Điều "), "l_linenumber", F.lit(". Mục tiêu")).alias("text"))
    got = F.when(F.col("l_linenumber") % 3 > 0, F.struct((F.col("page") + F.when(F.col("l_linenumber") % 5 == 0, 1).otherwise(0)).alias("page"), "text"))
    d = i.groupBy(F.col("l_orderkey").alias("pair_id")).agg(F.array_sort(F.collect_set(F.struct("page", "text", "label"))).alias("expected"), F.array_sort(F.collect_list(got)).alias("selected"))
    return S.scores(d)
