"""Queries of the window and sequence operators. Orders are documents, their items lines; users' events are longer sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratafolio.operators import windows as W
from stratafolio.plans.registry import query
from stratafolio.session import table

KEYS = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
#: An order's items in a total order; ``num`` is the number that an item bears, which repeats and leaves gaps.
ITEMS = f"items AS (SELECT *, l_orderkey AS doc, l_linenumber AS num, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(KEYS)}) AS ord FROM lineitem)"


def with_items(sql: str) -> str:
    return f"WITH {ITEMS}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {ITEMS} {sql}"


def items(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("doc", F.col("l_orderkey")).withColumn("num", F.col("l_linenumber"))
    return df.withColumn("ord", F.row_number().over(Window.partitionBy("doc").orderBy(*KEYS)))


def hundredths(x):
    """Rounded as DuckDB does, by the product in binary and not by the decimal digits; a small negative number keeps its sign."""
    r = F.round(x * 100) / 100
    return F.when(F.isnan(r) | (F.abs(r) == float("inf")), x).when(r == 0, x * F.lit(0.0)).otherwise(r)


@query("w1_neighbours", with_items("""SELECT doc, ord, array_to_string(list(l_quantity::INT) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ',') AS before,
  array_to_string(list(l_quantity::INT) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ',') AS after FROM (SELECT doc, ord, l_quantity FROM items)""".replace("array_to_string(list", "coalesce(array_to_string(list").replace(", ',') AS", ", ','), '') AS")))
def w1(spark, sf):
    df = items(spark, sf).withColumn("q", F.col("l_quantity").cast("int").cast("string"))
    out = W.neighbours(df, ["doc"], "ord", "q", 2)
    return out.select("doc", "ord", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query("w2_islands", """WITH p AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events),
  r AS (SELECT *, place - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM p WHERE value > 20)
  SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS size FROM r GROUP BY user_id, run""")
def w2(spark, sf):
    return W.islands(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") > 20)


@query("w3_capped_blocks", """WITH b AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type IS DISTINCT FROM prev OR first THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS block
  FROM (SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w = 1 AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))),
  c AS (SELECT *, (row_number() OVER (PARTITION BY user_id, block ORDER BY event_id) - 1) % 3 = 0 AS starts FROM b)
  SELECT user_id, event_id, event_type, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS block FROM c""")
def w3(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    df = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return W.blocks(df, ["user_id"], "event_id", F.lag("event_type").over(w) != F.col("event_type"), cap=3)


@query("w4_split_groups", with_items("""WITH g AS (SELECT doc, ord, l_returnflag = 'R' AS numbered, sum((l_returnflag = 'R')::INT) OVER (PARTITION BY doc) AS n FROM items)
  SELECT doc, ord, CASE WHEN n >= 2 THEN 1 + sum((numbered AND ord > 1)::INT) OVER (PARTITION BY doc ORDER BY ord) ELSE 1 END::BIGINT AS part FROM g"""))
def w4(spark, sf):
    numbered = F.col("l_returnflag") == "R"
    df = items(spark, sf).withColumn("n", F.sum(numbered.cast("int")).over(Window.partitionBy("doc")))
    cut = W.blocks(df, ["doc"], "ord", numbered | (F.col("ord") == 1))
    return cut.select("doc", "ord", F.when(F.col("n") >= 2, F.col("block")).otherwise(1).cast("long").alias("part"))


@query("w5_sequences", with_items("""WITH s AS (SELECT doc, l_returnflag AS form, ord, CASE WHEN ord = lag(ord) OVER (PARTITION BY doc, l_returnflag ORDER BY ord) + 1 THEN 0 ELSE 1 END AS broken FROM items),
  c AS (SELECT *, sum(broken) OVER (PARTITION BY doc, form ORDER BY ord) AS chain FROM s)
  SELECT doc, form, min(ord) AS first, min(ord) AS low, max(ord) AS high, count(*) AS size FROM c GROUP BY doc, form, chain HAVING count(*) >= 2"""))
def w5(spark, sf):
    df = items(spark, sf).select("doc", F.col("l_returnflag").alias("form"), "ord", F.col("ord").alias("value"))
    return W.sequences(df, ["doc"], "form", "ord", "value")


@query("w6_sequence_anomalies", with_items("""WITH s AS (SELECT doc, l_linestatus AS key, row_number() OVER (PARTITION BY doc ORDER BY l_shipdate, ord) AS place, num AS value FROM items),
  p AS (SELECT *, lag(value) OVER (PARTITION BY doc, key ORDER BY place) AS previous FROM s)
  SELECT doc, key, place, value, previous, CASE WHEN value > previous + 1 THEN 'gap' WHEN value < previous THEN 'decrease' ELSE 'repeat' END AS kind,
  CASE WHEN value > previous + 1 THEN value - previous - 1 END AS missing FROM p WHERE previous IS NOT NULL AND value <> previous + 1"""))
def w6(spark, sf):
    place = F.row_number().over(Window.partitionBy("doc").orderBy("l_shipdate", "ord"))
    df = items(spark, sf).select("doc", F.col("l_linestatus").alias("key"), place.alias("place"), F.col("num").alias("value"))
    return W.anomalies(df, ["doc"], "key", "place", "value").select("doc", "key", "place", "value", "previous", "kind", "missing")


@query("w6_missing_candidates", with_items("""WITH p AS (SELECT doc, ord AS gap_ord, l_returnflag AS key, num AS value, lag(num) OVER (PARTITION BY doc, l_returnflag ORDER BY ord) AS previous FROM items),
  g AS (SELECT * FROM p WHERE value > previous + 1),
  c AS (SELECT g.doc, g.key, g.gap_ord, g.previous, g.value, l.l_returnflag AS other_key, l.num AS other, row_number() OVER (PARTITION BY g.doc, g.key, g.gap_ord ORDER BY l.num, l.ord) AS n
  FROM g JOIN items l ON l.doc = g.doc AND l.l_returnflag <> g.key AND l.num > g.previous AND l.num < g.value)
  SELECT doc, key, previous, value, other_key, other FROM c WHERE n <= 3"""))
def w6_candidates(spark, sf):
    df = items(spark, sf).select("doc", F.col("l_returnflag").alias("key"), "ord", F.col("num").alias("value"))
    gaps = W.anomalies(df, ["doc"], "key", "ord", "value").filter("kind = 'gap'").select("doc", "key", F.col("ord").alias("gap_ord"), "previous", "value")
    other = df.select("doc", F.col("key").alias("other_key"), F.col("value").alias("other"), "ord")
    found = gaps.join(other, "doc").filter("other_key <> key AND other > previous AND other < value")
    return W.top_k(found, ["doc", "key", "gap_ord"], [F.col("other"), F.col("ord")], 3).select("doc", "key", "previous", "value", "other_key", "other")


@query("w7_segment_gaps", """SELECT o_custkey AS row, o_orderkey AS id, row_number() OVER w AS segment, count(*) OVER (PARTITION BY o_custkey) AS segments,
  round(o_totalprice - lag(o_totalprice + 10) OVER w, 2) AS gap_before, round(lead(o_totalprice) OVER w - (o_totalprice + 10), 2) AS gap_after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_totalprice + 10)""")
def w7(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_custkey").alias("row"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("left"), (F.col("o_totalprice") + 10).alias("right"))
    out = W.segment_gaps(df, ["row"], "left", "right", ["id"])
    return out.select("row", "id", "segment", "segments", hundredths(F.col("gap_before")).alias("gap_before"), hundredths(F.col("gap_after")).alias("gap_after"))


@query("w8_place_in_block", with_items("""WITH b AS (SELECT doc, ord, l_returnflag AS block, row_number() OVER (PARTITION BY doc, l_returnflag ORDER BY ord) AS place,
  count(*) OVER (PARTITION BY doc, l_returnflag) AS size, min(ord) OVER (PARTITION BY doc, l_returnflag) AS f FROM items)
  SELECT doc, ord, block, place, size, dense_rank() OVER (PARTITION BY doc ORDER BY f) AS block_number FROM b"""))
def w8(spark, sf):
    return W.place_in_block(items(spark, sf).select("doc", "ord", F.col("l_returnflag").alias("block")), ["doc"], "block", "ord")


@query("w11_crossings", with_items("""WITH p AS (SELECT doc, ord AS old, row_number() OVER (PARTITION BY doc ORDER BY l_shipdate, ord) AS new FROM items)
  SELECT doc, old, new, coalesce(max(new) OVER (PARTITION BY doc ORDER BY old ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > new, false) OR coalesce(min(new) OVER (PARTITION BY doc ORDER BY old ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) < new, false) AS crosses FROM p"""))
def w11(spark, sf):
    new = F.row_number().over(Window.partitionBy("doc").orderBy("l_shipdate", "ord"))
    return W.crossings(items(spark, sf).select("doc", F.col("ord").alias("old"), new.alias("new")), ["doc"], "old", "new")


@query("a16_moved_blocks", with_items("""WITH p AS (SELECT doc, ord AS old, row_number() OVER (PARTITION BY doc ORDER BY l_shipdate, ord) AS new FROM items),
  c AS (SELECT *, coalesce(max(new) OVER (PARTITION BY doc ORDER BY old ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > new, false) OR coalesce(min(new) OVER (PARTITION BY doc ORDER BY old ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) < new, false) AS crosses FROM p),
  l AS (SELECT doc, old, new, CASE WHEN old = lag(old) OVER w + 1 AND new = lag(new) OVER w + 1 THEN 0 ELSE 1 END AS broken FROM c WHERE crosses WINDOW w AS (PARTITION BY doc ORDER BY old)),
  b AS (SELECT *, sum(broken) OVER (PARTITION BY doc ORDER BY old)::BIGINT AS block FROM l)
  SELECT doc, block, min(old) AS old_first, min(new) AS new_first, count(*) AS size FROM b GROUP BY doc, block"""))
def a16(spark, sf):
    new = F.row_number().over(Window.partitionBy("doc").orderBy("l_shipdate", "ord"))
    return W.moved_blocks(items(spark, sf).select("doc", F.col("ord").alias("old"), new.alias("new")), ["doc"], "old", "new")


@query("w12_since_same", """WITH p AS (SELECT user_id, event_id, event_type, (event_id % 3)::BIGINT AS instance, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS place FROM events)
  SELECT user_id, event_id, event_type, instance, place - lag(place) OVER (PARTITION BY user_id, event_type, instance ORDER BY event_id) - 1 AS since FROM p""")
def w12(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 3).alias("instance"))
    return W.since_same(df, ["user_id"], "event_type", "instance", "event_id")


@query("w15_look_alikes", """WITH g AS (SELECT user_id, event_type AS look, count(*) AS size, count(DISTINCT value > 30) AS decisions, count(DISTINCT event_id % 4) AS requests FROM events GROUP BY user_id, event_type)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY look) AS n FROM g WHERE size BETWEEN 2 AND 24 AND decisions > 1 AND requests > 1) WHERE n <= 2""".replace("SELECT * FROM (SELECT *, row", "SELECT user_id, look, size, decisions, requests FROM (SELECT *, row"))
def w15(spark, sf):
    df = table(spark, sf, "events").select("user_id", F.col("event_type").alias("look"), (F.col("value") > 30).alias("decision"), (F.col("event_id") % 4).alias("request"))
    return W.look_alikes(df, ["user_id"], "look", "decision", "request", limit=2)


@query("w16_fixed_windows", """SELECT user_id, w, count(*) AS lines, min(event_id) AS first FROM (SELECT *, floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 7)::BIGINT AS w FROM events) GROUP BY user_id, w""")
def w16(spark, sf):
    out = W.fixed_windows(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", 7)
    return out.groupBy("user_id", F.col("window").alias("w")).agg(F.count(F.lit(1)).alias("lines"), F.min("event_id").alias("first"))


@query("w21_position", with_items("""SELECT doc, ord, CASE WHEN max(l_extendedprice) OVER w > min(l_extendedprice) OVER w THEN round((l_extendedprice - min(l_extendedprice) OVER w) / (max(l_extendedprice) OVER w - min(l_extendedprice) OVER w), 3) ELSE 0 END AS position FROM items WINDOW w AS (PARTITION BY doc)"""))
def w21(spark, sf):
    return W.relative_position(items(spark, sf).select("doc", "ord", "l_extendedprice"), ["doc"], "l_extendedprice").select("doc", "ord", "position")


@query("w22_region_spans", """WITH s AS (SELECT user_id, event_id - 30 AS a, event_id + 30 AS b FROM events WHERE event_type = 'click'), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
  r AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b) AS block FROM m)
  SELECT user_id, min(a) AS start, max(b) AS end, count(*) AS parts FROM r GROUP BY user_id, block""")
def w22(spark, sf):
    df = table(spark, sf, "events").filter("event_type = 'click'").select("user_id", (F.col("event_id") - 30).alias("a"), (F.col("event_id") + 30).alias("b"))
    return W.merged_spans(df, ["user_id"], "a", "b")


@query("w23_context_changed", """SELECT user_id, event_id, max((value > 90)::INT) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING) = 1 AS context_changed FROM events""")
def w23(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_id", "value")
    return W.near_change(df, ["user_id"], "event_id", F.col("value") > 90, 200).select("user_id", "event_id", "context_changed")


@query("st2_page", """SELECT o_custkey, o_orderkey, n, total, total > 6 AS has_more, CASE WHEN total > 6 THEN 6 END AS next_offset FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE n BETWEEN 4 AND 6""")
def st2(spark, sf):
    return W.page(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 3, 3)


@query("st3_fitting", with_items("""SELECT * FROM (SELECT doc, ord, sum(l_quantity) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS used FROM items) WHERE used <= 80"""))
def st3(spark, sf):
    return W.fitting(items(spark, sf).select("doc", "ord", "l_quantity"), ["doc"], ["ord"], F.col("l_quantity"), 80).select("doc", "ord", "used")


@query("st4_top_k", """SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def st4(spark, sf):
    return W.top_k(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("st5_arg_max", """SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS best, arg_min(o_orderkey, o_totalprice) AS worst FROM orders GROUP BY o_custkey""")
def st5(spark, sf):
    """Of equal prices the first order's, which DuckDB meets first; orders without a price take no part."""
    at = lambda key: F.when(F.col("o_totalprice").isNotNull() & F.col("o_orderkey").isNotNull(), F.struct("o_totalprice", key))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", at((-F.col("o_orderkey")).alias("k"))).alias("best"), F.min_by("o_orderkey", at(F.col("o_orderkey").alias("k"))).alias("worst"))
