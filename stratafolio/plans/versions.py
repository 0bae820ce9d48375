"""Queries of the diff operators. The versions of a pair are a document and what a rule makes of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafolio.operators import diff as D
from stratafolio.plans.registry import query
from stratafolio.session import table


def pairs(spark, sf):
    """Every document, and its text with each seventh line left out, words put into each fifth and each ninth doubled."""
    old = F.split("text", "\n")
    edit = lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("as amended "), x)).when(i % 9 == 4, F.concat(x, F.lit("\n"), x)).otherwise(x)
    new = F.array_join(F.transform(F.filter(old, lambda x, i: i % 7 != 3), edit), "\n")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("old"), new.alias("new"))


@query("a9_compare")
def a9(spark, sf):
    return D.changes(pairs(spark, sf))


@query("a11_table_diff")
def a11(spark, sf):
    """Each order's items as a table of four columns, and the same without its third row, with another price in each fifth and the first
    row at the end."""
    cell = lambda c: F.col(c).cast("string")
    i = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("at"), F.array(cell("l_partkey"), cell("l_suppkey"), cell("l_quantity"), cell("l_shipdate")).alias("row"))
    old = i.groupBy(F.col("l_orderkey").alias("pair_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "row"))), lambda x: x["row"]).alias("old"))
    priced = lambda r, k: F.when(k % 5 == 1, F.concat(F.slice(r, 1, 2), F.array(F.lit("sold")), F.slice(r, 4, 1))).otherwise(r)
    less = F.transform(F.filter("old", lambda r, k: k != 2), priced)
    return D.table_changes(old.withColumn("new", F.concat(F.slice(less, F.lit(2), F.greatest(F.size(less) - 1, F.lit(0))), F.slice(less, 1, 1))))


@query("a2_text_hunks")
def a2(spark, sf):
    """Names of parts against their types and sizes."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("pair_id"), F.col("p_name").alias("old"), F.concat_ws(" ", F.lower("p_type"), "p_name", F.col("p_size").cast("string")).alias("new"))
    return D.text_hunks(p)


@query("a10_one_sided", """WITH l AS (SELECT DISTINCT doc_id % 2 AS side, source, unnest(string_split(text, chr(10))) AS line, doc_id FROM documents),
  g AS (SELECT source, line, list_sort(list(DISTINCT side)) AS sides, count(*) AS times FROM l GROUP BY ALL) SELECT source, md5(line) AS line, times, sides[1] AS side FROM g WHERE len(sides) = 1""")
def a10(spark, sf):
    l = table(spark, sf, "documents").select((F.col("doc_id") % 2).alias("side"), "source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).distinct()  # noqa: E741
    return D.one_sided(l, "side", "line", ["source"]).withColumn("line", F.md5(F.col("line").cast("binary")))


@query("a15_style_changes", """WITH a AS (SELECT n_nationkey AS k, n_regionkey AS v FROM nation WHERE n_nationkey < 20), b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 9 ELSE n_regionkey END AS v FROM nation WHERE n_nationkey > 4)
  SELECT k, a.v AS old, b.v AS new FROM a FULL JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v""")
def a15(spark, sf):
    n = table(spark, sf, "nation")
    a = n.filter("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("old"))
    b = n.filter("n_nationkey > 4").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 3 == 0, 9).otherwise(F.col("n_regionkey")).alias("new"))
    return a.join(b, "k", "full").filter(~F.col("old").eqNullSafe(F.col("new")))


@query("a19_section_signal", """WITH s AS (SELECT l_orderkey, l_returnflag, sha256(array_to_string(list(length(l_shipdate::DATE::VARCHAR) || ':' || l_shipdate::DATE::VARCHAR ORDER BY l_shipdate), '')) AS signature FROM lineitem GROUP BY ALL) SELECT * FROM s""")
def a19(spark, sf):
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    signed = F.concat(F.length(day).cast("string"), F.lit(":"), day)
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(signed)), "").cast("binary"), 256).alias("signature"))


@query("a23_review_state", """WITH last AS (SELECT user_id, event_type, arg_max(value > 25, event_id) AS done FROM events GROUP BY ALL) SELECT user_id, CASE WHEN bool_and(done) THEN 'REVIEWED' WHEN bool_or(done) THEN 'PARTIAL' ELSE 'UNREVIEWED' END AS state FROM last GROUP BY user_id""")
def a23(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by(F.col("value") > 25, "event_id").alias("done"))
    return last.groupBy("user_id").agg(F.when(F.bool_and("done"), "REVIEWED").when(F.bool_or("done"), "PARTIAL").otherwise("UNREVIEWED").alias("state"))
