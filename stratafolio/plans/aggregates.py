"""Queries of the aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafolio.operators import aggregates as A
from stratafolio.plans.registry import query
from stratafolio.plans.windows import items, with_items
from stratafolio.session import table


@query("ag1_style_table", """WITH l AS (SELECT o_custkey AS doc, o_orderstatus AS name, round(o_totalprice / 100000) AS size, o_orderpriority < '2' AS bold, o_orderkey AS ord FROM orders),
  g AS (SELECT doc, name, size, bold, count(*) AS lines, array_to_string(list_slice(list(ord ORDER BY ord), 1, 3), ',') AS examples FROM l GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY size DESC NULLS LAST, bold DESC, name) AS rank FROM g) WHERE rank <= 15""")
def ag1(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("name"), F.round(F.col("o_totalprice") / 100000).alias("size"),
        (F.col("o_orderpriority") < "2").alias("bold"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("text"),
    )
    out = A.style_table(df, ["doc"], ["name", "size", "bold"], "size", "bold", "name", "ord", "text")
    return out.withColumn("examples", F.array_join("examples", ","))


@query("ag2_repeated_text", """WITH l AS (SELECT doc_id % 50 AS doc, doc_id AS page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents),
  k AS (SELECT doc, page, ord, lower(regexp_replace(text, '[0-9]+', '#', 'g')) AS key FROM l),
  g AS (SELECT doc, key, count(*) AS n, count(DISTINCT page) AS pages, min(page) AS first_page, max(page) AS last_page FROM k WHERE length(key) > 0 GROUP BY doc, key)
  SELECT k.doc, page, ord, coalesce(n - 1, 0) AS others, pages, first_page, last_page FROM k LEFT JOIN g USING (doc, key)""")
def ag2(spark, sf):
    return repeated_text(table(spark, sf, "documents"))


def repeated_text(documents):
    docs = documents.select((F.col("doc_id") % 50).alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    key = F.lower(F.regexp_replace("text", "[0-9]+", "#"))
    out = A.repeats(docs.withColumn("ord", F.col("ord") + 1), ["doc"], key, "page")
    return out.select("doc", "page", "ord", "others", "pages", "first_page", "last_page")


@query("ag3_dominant_size", """WITH s AS (SELECT l_orderkey, l_quantity, sum(l_partkey) AS w FROM lineitem GROUP BY ALL)
  SELECT l_orderkey, l_quantity AS dominant, w::BIGINT AS dominant_weight FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, l_quantity) AS n FROM s) WHERE n = 1""")
def ag3(spark, sf):
    return A.dominant(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", F.col("l_partkey"))


@query("ag5_upper_middle", """SELECT l_orderkey, list(l_extendedprice ORDER BY l_extendedprice)[(count(*) // 2 + 1)::INT] AS upper_middle, count(*) AS lines, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_orderkey""")
def ag5(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        A.upper_middle("l_extendedprice").alias("upper_middle"), F.count(F.lit(1)).alias("lines"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")
    )


@query("ag6_median_and_edge", """WITH e AS (SELECT a.l_orderkey, a.l_quantity AS edge, count(*) AS near FROM (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem) a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_quantity - b.l_quantity) <= 1.5 GROUP BY ALL),
  t AS (SELECT l_orderkey, edge, near, row_number() OVER (PARTITION BY l_orderkey ORDER BY near DESC, edge) AS n FROM e), m AS (SELECT l_orderkey, median(l_extendedprice) AS median FROM lineitem GROUP BY ALL)
  SELECT l_orderkey, median, edge, near FROM m JOIN t USING (l_orderkey) WHERE n = 1""")
def ag6(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    near = df.withColumn("near", F.expr("count(1) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE BETWEEN 1.5D PRECEDING AND 1.5D FOLLOWING)"))
    edge = near.groupBy("l_orderkey").agg(F.median("l_extendedprice").alias("median"), F.min_by(F.struct(F.col("l_quantity").alias("edge"), "near"), F.struct(-F.col("near"), F.col("l_quantity"))).alias("b"))
    return edge.select("l_orderkey", "median", "b.edge", "b.near")


@query("ag7_pitch", """WITH g AS (SELECT user_id, floor(((event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id)) / 100.0::DOUBLE) / 0.05::DOUBLE)::BIGINT AS bucket FROM events),
  c AS (SELECT user_id, bucket, count(*) AS n FROM g WHERE bucket IS NOT NULL GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM c), l AS (SELECT user_id, min(bucket) AS bucket FROM t WHERE n >= 0.05::DOUBLE * total GROUP BY user_id)
  SELECT user_id, bucket, round(least(greatest(bucket * 0.05::DOUBLE, 1), 2), 2) AS pitch FROM l""")
def ag7(spark, sf):
    return A.pitch(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", "event_id", F.lit(100.0))


@query("ag8_overview", """SELECT lang, count(*) AS lines, count(DISTINCT source) AS pages, min(n_chars) AS low, max(n_chars) AS high, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang""")
def ag8(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("source").alias("pages"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.sum("n_chars").alias("chars")
    )


@query("ag9_gold_score", """WITH g AS (SELECT DISTINCT o_custkey AS doc, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT DISTINCT o_custkey AS doc, o_orderkey AS id FROM orders WHERE o_totalprice > 150000),
  j AS (SELECT coalesce(g.doc, p.doc) AS doc, g.id AS g, p.id AS p FROM g FULL JOIN p ON g.doc = p.doc AND g.id = p.id), c AS (SELECT doc, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM j GROUP BY doc)
  SELECT doc, tp, fp, fn, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1 FROM c""")
def ag9(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")
    return A.score(rows.filter("o_orderstatus = 'F'"), rows.filter("o_totalprice > 150000"), ["doc"], ["id"])


@query("ag11_error_rate", """SELECT p_brand, count(*) AS lines, count(*) FILTER (p_name = lower(p_type)) AS exact, sum(levenshtein(p_name, lower(p_type))) / sum(length(p_name))::DOUBLE AS error_rate FROM part GROUP BY p_brand""")
def ag11(spark, sf):
    return A.error_rate(table(spark, sf, "part").withColumn("read", F.lower("p_type")), ["p_brand"], "p_name", "read")


@query("ag12_conflicts", """WITH f AS (SELECT user_id, upper(event_type) AS label_key, (value > 60)::VARCHAR AS v FROM events)
  SELECT user_id, label_key, array_to_string(list_sort(list(DISTINCT v)), ',') AS values, count(*) AS facts FROM f GROUP BY ALL HAVING count(DISTINCT v) > 1""")
def ag12(spark, sf):
    df = table(spark, sf, "events").select("user_id", "event_type", (F.col("value") > 60).cast("string").alias("v"))
    return A.conflicts(df, ["user_id"], F.upper("event_type"), "v").withColumn("values", F.array_join("values", ","))


@query("ag13_first_kept", """SELECT user_id, event_id, event_type, row_number() OVER w = 1 AS kept, first_value(event_id) OVER w AS kept_order FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)""")
def ag13(spark, sf):
    return A.first_kept(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_type", "event_id")


@query("ag15_also_in", """WITH f AS (SELECT DISTINCT l_partkey AS fact, l_suppkey % 7 AS place FROM lineitem), a AS (SELECT a.fact, a.place, list_sort(list(b.place) FILTER (b.place <> a.place)) AS o FROM f a JOIN f b USING (fact) GROUP BY ALL)
  SELECT fact, place, coalesce(array_to_string(o, ','), '') AS also_in FROM a""")
def ag15(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("fact"), (F.col("l_suppkey") % 7).alias("place")).distinct()
    return A.also_in(df, "fact", "place").withColumn("also_in", F.array_join(F.transform("also_in", lambda x: x.cast("string")), ","))


@query("ag16_level_shift", """WITH d AS (SELECT o_custkey AS doc, (o_orderkey % 2 + (o_orderkey % 11 = 0)::INT)::BIGINT AS delta, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY doc)::BIGINT AS total FROM d) SELECT * FROM t WHERE delta <> 0 AND n >= 3 AND 3 * n >= 2 * total""")
def ag16(spark, sf):
    delta = F.col("o_orderkey") % 2 + (F.col("o_orderkey") % 11 == 0).cast("int")
    return A.level_shift(table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), delta.alias("delta")), ["doc"], "delta")


@query("ag18_confidence", """SELECT l_orderkey, round_even(avg(l_tax * 100 + l_linenumber::DOUBLE * 0.5), 1) AS mean, min(l_tax * 100) AS low FROM lineitem GROUP BY l_orderkey""")
def ag18(spark, sf):
    value = F.col("l_tax") * 100 + F.col("l_linenumber") * 0.5
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bround(F.avg(value), 1).alias("mean"), F.min(F.col("l_tax") * 100).alias("low"))


@query("ag20_status_counts", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS partial, max(o_totalprice) AS most FROM orders GROUP BY o_orderpriority""")
def ag20(spark, sf):
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(is_("F").alias("finished"), is_("O").alias("open"), is_("P").alias("partial"), F.max("o_totalprice").alias("most"))


@query("ag21_segment_sizes", """WITH s AS (SELECT o_custkey AS seg, count(*) AS n FROM orders GROUP BY ALL) SELECT c_nationkey, count(*) AS segments, min(n) AS low, max(n) AS high, avg(n) AS mean, count(*) FILTER (n > 12) AS over_window FROM s JOIN customer ON c_custkey = seg GROUP BY c_nationkey""")
def ag21(spark, sf):
    seg = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return seg.join(table(spark, sf, "customer"), "c_custkey").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("segments"), F.min("n").alias("low"), F.max("n").alias("high"), F.avg("n").alias("mean"), F.count_if(F.col("n") > 12).alias("over_window")
    )


@query("g6_two_groups", with_items("""WITH o AS (SELECT doc, l_quantity AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc) AS n, sum(l_quantity) OVER (PARTITION BY doc ORDER BY l_quantity, ord ROWS UNBOUNDED PRECEDING) AS low, sum(l_quantity) OVER (PARTITION BY doc) AS total, lead(l_quantity) OVER w AS next FROM items WINDOW w AS (PARTITION BY doc ORDER BY l_quantity, ord)),
  s AS (SELECT *, round(i * (n - i) * pow(low / i - (total - low) / (n - i), 2), 6) AS spread FROM o WHERE n >= 3 AND next IS NOT NULL)
  SELECT doc, i, (v + next) / 2 AS cut FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY spread DESC, i) AS r FROM s) WHERE r = 1"""))
def g6(spark, sf):
    return A.two_groups(items(spark, sf).select("doc", "l_quantity"), ["doc"], "l_quantity")


@query("g19_timings", """SELECT event_type, count(*) AS calls, list(value ORDER BY value)[(floor(count(*) * 0.5) + 1)::INT] AS half, list(value ORDER BY value)[(floor(count(*) * 0.9) + 1)::INT] AS most, max(value) AS slowest, round(sum(value), 4) AS total FROM events GROUP BY event_type""")
def g19(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("calls"), A.at_share("value", 0.5).alias("half"), A.at_share("value", 0.9).alias("most"), F.max("value").alias("slowest"), F.round(F.sum("value"), 4).alias("total")
    )


@query("g29_relative_size", """WITH b AS (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity)[(count(*) // 2 + 1)::INT] AS body FROM lineitem WHERE l_quantity > 0 GROUP BY l_orderkey) SELECT l_orderkey, l_partkey, l_quantity, round(l_quantity / body, 3) AS relative FROM lineitem JOIN b USING (l_orderkey)""")
def g29(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    body = df.filter("l_quantity > 0").groupBy("l_orderkey").agg(A.upper_middle("l_quantity").alias("body"))
    return df.join(body, "l_orderkey").withColumn("relative", F.round(F.col("l_quantity") / F.col("body"), 3)).drop("body")


@query("g31_newest", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5""")
def g31(spark, sf):
    from stratafolio.operators.windows import top_k

    return top_k(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")
