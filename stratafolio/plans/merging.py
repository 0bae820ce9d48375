"""Queries of layout, packing and merging, and of the evidence tools."""

from __future__ import annotations

import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratafolio.operators import binding as B
from stratafolio.operators import layout as L
from stratafolio.operators import merge as M
from stratafolio.operators import packing as P
from stratafolio.operators import windows as W
from stratafolio.plans.lines import LINES
from stratafolio.plans.registry import query
from stratafolio.plans.trees import H, headings
from stratafolio.plans.windows import items, with_items
from stratafolio.session import table
from stratafolio.sources.lines import lines

LOWER, UPPER = string.ascii_lowercase, string.ascii_uppercase


@query("sc9_atoms", with_items("""WITH b AS (SELECT doc, ord, CASE WHEN abs(l_quantity - lag(l_quantity) OVER (PARTITION BY doc ORDER BY ord)) <= 8 THEN 0 ELSE 1 END AS fresh FROM items), g AS (SELECT doc, ord, sum(fresh) OVER (PARTITION BY doc ORDER BY ord)::BIGINT AS row FROM b)
  SELECT doc, ord, row, row_number() OVER (PARTITION BY doc, row ORDER BY ord) AS segment, printf('L%04d:S%d', row, row_number() OVER (PARTITION BY doc, row ORDER BY ord)) AS alias FROM g"""))
def sc9(spark, sf):
    w = Window.partitionBy("doc").orderBy("ord")
    return L.atoms(items(spark, sf).select("doc", "ord", "l_quantity"), ["doc"], "ord", F.abs(F.col("l_quantity") - F.lag("l_quantity").over(w)) <= 8).select("doc", "ord", "row", "segment", "alias")


@query("sc12_ink_rows", """WITH b AS (SELECT user_id, event_id AS l, event_id + 4 AS r FROM events), m AS (SELECT *, max(r) OVER (PARTITION BY user_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
  g AS (SELECT *, sum(CASE WHEN l - reach <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY l, r)::BIGINT AS run FROM m) SELECT user_id, run, min(l) AS "left", max(r) AS "right", count(*) AS marks FROM g GROUP BY user_id, run HAVING count(*) >= 3 AND max(r) - min(l) >= 80""")
def sc12(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("l"), (F.col("event_id") + 4).alias("r"))
    return L.ink_rows(e, ["user_id"], "l", "r", 100, 3, 80).select("user_id", "run", "left", "right", "marks")


BOXES = "b AS (SELECT doc, ord, num * 10.0::DOUBLE AS l, l_quantity AS t, num * 10 + 5 + l_quantity AS r, l_quantity * 2 AS bt FROM items)"


@query("g20_best_overlap", with_items(f"""WITH {BOXES}, x AS (SELECT a.doc, a.ord AS g, b.ord, greatest(least(a.r, b.r) - greatest(a.l, b.l), 0) * greatest(least(a.bt, b.bt) - greatest(a.t, b.t), 0) AS i, (a.r - a.l) * (a.bt - a.t) + (b.r - b.l) * (b.bt - b.t) AS u FROM b a JOIN b ON a.doc = b.doc AND a.ord % 2 = 0 AND b.ord % 2 = 1),
  y AS (SELECT doc, g, ord, round(CASE WHEN u - i > 0 THEN i / (u - i) ELSE 0 END, 9) AS iou FROM x) SELECT doc, g AS g_id, ord, iou FROM (SELECT *, row_number() OVER (PARTITION BY doc, g ORDER BY iou DESC, ord) AS n FROM y WHERE iou >= 0.3) WHERE n = 1"""))
def g20(spark, sf):
    q = F.col("l_quantity")
    b = items(spark, sf).select("doc", "ord", (F.col("num") * 10.0).alias("left"), q.alias("top"), (F.col("num") * 10 + 5 + q).alias("right"), (q * 2).alias("bottom"))
    gold = b.filter("ord % 2 = 0").select("doc", F.col("ord").alias("g_id"), *[F.col(c).alias(f"g_{c}") for c in ("left", "top", "right", "bottom")])
    return L.best_overlap(gold, b.filter("ord % 2 = 1"), ["doc"], 0.3, "ord").select("doc", "g_id", "ord", F.round("iou", 9).alias("iou"))


@query("g16_peers", """WITH b AS (SELECT o_custkey AS page, o_orderkey AS id, o_totalprice AS l FROM orders), m AS (SELECT a.page, a.id, b.id AS other, abs(a.id - b.id) AS far FROM b a JOIN b ON a.page = b.page AND a.id <> b.id AND abs(a.l - b.l) <= 20000)
  SELECT page, id, count(*) AS peers, array_to_string(list_slice(list(other ORDER BY far, other), 1, 4), ',') AS nearest FROM m GROUP BY page, id""")
def g16(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("page"), "o_orderkey", "o_totalprice")
    out = L.peers(o, ["page"], "o_orderkey", "o_totalprice", 20000)
    return out.withColumn("nearest", F.array_join(F.transform("nearest", lambda x: x.cast("string")), ","))


@query("pr9_table_labels", """SELECT n_regionkey AS t, s_suppkey // 5 AS r, s_suppkey % 5 + 1 AS c, first_value(CASE WHEN s_suppkey % 5 = 0 THEN s_name END IGNORE NULLS) OVER (PARTITION BY n_regionkey, s_suppkey // 5) AS row_label,
  first_value(CASE WHEN s_suppkey // 5 = 1 THEN s_name END IGNORE NULLS) OVER (PARTITION BY n_regionkey, s_suppkey % 5) AS column_header FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0""".replace("JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0", "JOIN (SELECT 0 AS n_regionkey) ON true"))
def pr9(spark, sf):
    s = table(spark, sf, "supplier").select(F.lit(0).alias("t"), F.floor(F.col("s_suppkey") / 5).alias("r"), (F.col("s_suppkey") % 5 + 1).alias("c"), "s_name")
    return L.table_labels(s, ["t"], "r", "c", "s_name").select("t", "r", "c", "row_label", "column_header")


@query("w17_packing", f"""WITH RECURSIVE {LINES}, s AS (SELECT doc_id, ord, length(text) AS n FROM l),
  p AS (SELECT doc_id, ord, 1 AS batch, n AS size, 1 AS k FROM s WHERE ord = 1 UNION ALL SELECT s.doc_id, s.ord, CASE WHEN p.size + s.n <= 1000 AND k < 8 THEN p.batch ELSE p.batch + 1 END, CASE WHEN p.size + s.n <= 1000 AND k < 8 THEN p.size + s.n ELSE s.n END,
  CASE WHEN p.size + s.n <= 1000 AND k < 8 THEN k + 1 ELSE 1 END FROM p JOIN s ON s.doc_id = p.doc_id AND s.ord = p.ord + 1)
  SELECT doc_id, batch, min(ord) AS first, max(ord) AS last, count(*) AS rows, max(size) AS size FROM p GROUP BY doc_id, batch""")
def w17(spark, sf):
    l = lines(table(spark, sf, "documents")).withColumn("n", F.length("text"))  # noqa: E741
    return P.packed(l, ["doc_id"], "ord", "n", 1000, 8)


@query("w18_token_chunks", f"""WITH RECURSIVE {LINES}, s AS (SELECT doc_id, ord, ceil(length(text) / 1.85::DOUBLE)::BIGINT AS n FROM l),
  p AS (SELECT doc_id, ord, 1 AS batch, n AS size FROM s WHERE ord = 1 UNION ALL SELECT s.doc_id, s.ord, CASE WHEN p.size + s.n <= 400 THEN p.batch ELSE p.batch + 1 END, CASE WHEN p.size + s.n <= 400 THEN p.size + s.n ELSE s.n END FROM p JOIN s ON s.doc_id = p.doc_id AND s.ord = p.ord + 1)
  SELECT doc_id, batch, min(ord) AS first, max(ord) AS last, count(*) AS rows, max(size) AS size FROM p GROUP BY doc_id, batch""")
def w18(spark, sf):
    l = lines(table(spark, sf, "documents")).withColumn("n", P.tokens_of(F.length("text")))  # noqa: E741
    return P.packed(l, ["doc_id"], "ord", "n", 400, 1_000_000)


@query("w13_list_labels", f"""WITH {H}, k AS (SELECT doc, ord, 1 + id % 3 AS level FROM n), e AS (SELECT *, sum((level < 2)::INT) OVER w AS e2, sum((level < 3)::INT) OVER w AS e3 FROM k WINDOW w AS (PARTITION BY doc ORDER BY ord)),
  c AS (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY doc ORDER BY ord) AS c1, sum((level = 2)::INT) OVER (PARTITION BY doc, e2 ORDER BY ord) AS c2, sum((level = 3)::INT) OVER (PARTITION BY doc, e3 ORDER BY ord) AS c3 FROM e)
  SELECT doc, ord, concat_ws('.', greatest(c1, 1)::VARCHAR, CASE WHEN level >= 2 THEN greatest(c2, 1)::VARCHAR END, CASE WHEN level >= 3 THEN greatest(c3, 1)::VARCHAR END) AS label FROM c""")
def w13(spark, sf):
    return M.list_labels(headings(spark, sf).select("doc", "ord", (1 + F.col("id") % 3).alias("l")), ["doc"], "ord", "l", 3).select("doc", "ord", "label")


@query("d18_inherited", f"""WITH RECURSIVE {H}, k AS (SELECT doc, ord, CASE WHEN parent > 0 AND parent < ord THEN parent END AS up, CASE WHEN id % 4 = 0 THEN id % 9 END AS v FROM n),
  r AS (SELECT doc, ord, v, up FROM k UNION ALL SELECT r.doc, r.ord, k.v, k.up FROM r JOIN k ON r.doc = k.doc AND r.up = k.ord WHERE r.v IS NULL) SELECT doc, ord, max(v) AS effective FROM r GROUP BY doc, ord""")
def d18(spark, sf):
    p = F.when((F.col("parent") > 0) & (F.col("parent") < F.col("ord")), F.col("parent"))
    k = headings(spark, sf).select("doc", "ord", p.alias("up"), F.when(F.col("id") % 4 == 0, F.col("id") % 9).alias("v"))
    return M.inherited(k, ["doc"], "ord", "up", "v").select("doc", "ord", "effective")


@query("b3_quote_binding", f"""WITH {LINES}, q AS (SELECT doc_id, ord AS unit, CASE WHEN doc_id % 3 = 0 THEN translate(substr(text, 3, 12), '{LOWER}', '{UPPER}') ELSE substr(text, 3, 12) END AS quote FROM l WHERE ord = 2 AND length(text) > 20),
  s AS (SELECT q.doc_id, unit, l.ord AS lo, len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 12) = quote)) AS n, len(list_filter(range(1, length(text) + 1), lambda i: lower(substr(text, i, 12)) = lower(quote))) AS m FROM q JOIN l ON l.doc_id = q.doc_id AND abs(l.ord - q.unit) <= 3),
  f AS (SELECT doc_id, unit, coalesce(sum(n) FILTER (lo = unit), 0) AS here, count(*) FILTER (lo <> unit AND n = 1) AS near, coalesce(sum(m) FILTER (lo = unit), 0) AS folded, min(lo) FILTER (lo <> unit AND n = 1) AS first FROM s GROUP BY ALL),
  t AS (SELECT *, CASE WHEN here = 1 THEN 'EXACT' WHEN here > 1 THEN 'AMBIGUOUS' WHEN near = 1 THEN 'NEIGHBOUR' WHEN folded = 1 THEN 'CASE' ELSE 'MISSING' END AS status FROM f)
  SELECT doc_id, status, CASE WHEN status IN ('EXACT', 'CASE') THEN unit WHEN status = 'NEIGHBOUR' THEN first END AS bound_unit FROM t""")
def b3(spark, sf):
    l = lines(table(spark, sf, "documents")).select("doc_id", "ord", "text")  # noqa: E741
    part = F.substring("text", 3, 12)
    quote = F.when(F.col("doc_id") % 3 == 0, F.translate(part, LOWER, UPPER)).otherwise(part)
    q = l.filter((F.col("ord") == 2) & (F.length("text") > 20)).select("doc_id", F.col("ord").cast("long").alias("unit"), quote.alias("quote"), F.lit("text").alias("role"))
    units = l.withColumn("path", F.lit(None).cast("string")).withColumn("labels", F.lit(None).cast("array<string>"))
    return B.bound(q, units, ["doc_id"]).select("doc_id", "status", "bound_unit")


@query("a18_outline_diff", f"""WITH {H}, a AS (SELECT doc, id, level, parent FROM n WHERE id % 5 <> 0), b AS (SELECT doc, id, CASE WHEN id % 6 = 0 THEN level + 1 ELSE level END AS level, CASE WHEN id % 7 = 0 THEN 99 ELSE parent END AS parent FROM n WHERE id % 11 <> 0)
  SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'ADDED' WHEN b.id IS NULL THEN 'REMOVED' WHEN a.level <> b.level AND a.parent <> b.parent THEN 'LEVEL,PARENT' WHEN a.level <> b.level THEN 'LEVEL' WHEN a.parent <> b.parent THEN 'PARENT' ELSE 'SAME' END AS kinds
  FROM a FULL JOIN b ON a.doc = b.doc AND a.id = b.id""")
def a18(spark, sf):
    h = headings(spark, sf)
    new = h.filter("id % 11 <> 0").withColumn("level", F.when(F.col("id") % 6 == 0, F.col("level") + 1).otherwise(F.col("level"))).withColumn("parent", F.when(F.col("id") % 7 == 0, 99).otherwise(F.col("parent")))
    return M.outline_diff(h.filter("id % 5 <> 0"), new, ["doc"], "id", "level", "parent").select("doc", "id", "kinds")


@query("a21_region_plan", """SELECT user_id, count(*) AS rows, count(*) FILTER (value > 40) AS changed, CASE WHEN count(*) FILTER (value > 40) = 0 THEN 'UNCHANGED' WHEN count(*) FILTER (value > 40) > count(*) * 0.3::DOUBLE THEN 'FULL' ELSE 'REGION' END AS plan FROM events GROUP BY user_id""")
def a21(spark, sf):
    return M.region_plan(table(spark, sf, "events"), ["user_id"], F.col("value") > 40)


@query("a13_moved_rows", with_items("""WITH o AS (SELECT doc, l_suppkey AS k, count(*) AS n, min(ord) AS p FROM items WHERE ord % 4 <> 0 GROUP BY ALL), w AS (SELECT doc, l_suppkey AS k, count(*) AS n, min(ord) AS p FROM items WHERE ord % 3 <> 1 GROUP BY ALL)
  SELECT doc, k, CASE WHEN o.n > 1 OR w.n > 1 THEN 'UNCERTAIN' WHEN o.p <> w.p THEN 'MOVED' ELSE 'SAME' END AS status FROM o JOIN w USING (doc, k)"""))
def a13(spark, sf):
    r = items(spark, sf).select("doc", F.col("l_suppkey").alias("k"), "ord")
    return M.moved_rows(r.filter("ord % 4 <> 0"), r.filter("ord % 3 <> 1"), ["doc"], "k", "ord").select("doc", "k", "status")


@query("g25_verdicts", """WITH f AS (SELECT user_id, event_id % 30 AS item, arg_min(CASE event_type WHEN 'click' THEN 'KEEP' WHEN 'error' THEN 'EXCLUDE' ELSE 'OTHER' END, event_id) AS v FROM events GROUP BY ALL), i AS (SELECT DISTINCT user_id, unnest(range(0, 30)) AS item FROM events)
  SELECT user_id, item, CASE WHEN v = 'KEEP' THEN 'KEPT' WHEN v = 'EXCLUDE' THEN 'EXCLUDED' WHEN v IS NULL THEN 'MISSING' ELSE 'UNSURE' END AS state FROM i LEFT JOIN f USING (user_id, item)""")
def g25(spark, sf):
    e = table(spark, sf, "events")
    things = e.select("user_id").distinct().select("user_id", F.explode(F.expr("sequence(0L, 29L)")).alias("item"))
    said = F.when(F.col("event_type") == "click", "KEEP").when(F.col("event_type") == "error", "EXCLUDE").otherwise("OTHER")
    return M.verdicts(things, e.select("user_id", (F.col("event_id") % 30).alias("item"), "event_id", said.alias("verdict")), ["user_id"], "item", "event_id")


@query("g22_context_union", with_items("""WITH t AS (SELECT doc, ord FROM items WHERE l_quantity > 45), w AS (SELECT DISTINCT doc, unnest(range(ord - 2, ord + 3)) AS ord FROM t) SELECT doc, ord FROM items JOIN w USING (doc, ord)"""))
def g22(spark, sf):
    i = items(spark, sf).select("doc", "ord", "l_quantity")
    near = i.filter("l_quantity > 45").select("doc", F.explode(F.expr("sequence(ord - 2, ord + 2)")).alias("ord")).distinct()
    return i.select("doc", "ord").join(near, ["doc", "ord"], "left_semi")


@query("d16_run_merge", with_items("""WITH b AS (SELECT doc, ord, l_returnflag AS s, l_partkey::VARCHAR AS t, CASE WHEN l_returnflag = lag(l_returnflag) OVER (PARTITION BY doc ORDER BY ord) THEN 0 ELSE 1 END AS f FROM items), r AS (SELECT *, sum(f) OVER (PARTITION BY doc ORDER BY ord)::BIGINT AS run FROM b)
  SELECT doc, run, min(s) AS s, string_agg(t, '+' ORDER BY ord) AS text FROM r GROUP BY doc, run"""))
def d16(spark, sf):
    w = Window.partitionBy("doc").orderBy("ord")
    i = items(spark, sf).select("doc", "ord", F.col("l_returnflag").alias("s"), F.col("l_partkey").cast("string").alias("t"))
    runs = W.blocks(i, ["doc"], "ord", F.lag("s").over(w) != F.col("s"))
    merged = runs.groupBy("doc", F.col("block").alias("run")).agg(F.min("s").alias("s"), F.sort_array(F.collect_list(F.struct("ord", "t"))).alias("p"))
    return merged.select("doc", "run", "s", F.array_join(F.transform("p", lambda x: x["t"]), "+").alias("text"))


@query("fv18_transcription", """WITH t AS (SELECT p_partkey, p_name AS read, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before, p_type AS known FROM part)
  SELECT p_partkey, CASE WHEN contains(read, chr(10)) THEN 'MULTI_LINE' WHEN trim(read) = '' THEN 'EMPTY' WHEN before = read THEN 'NEIGHBOUR' WHEN length(read) > 1.5::DOUBLE * length(known) THEN 'LONGER' END AS reason FROM t""")
def fv18(spark, sf):
    from stratafolio.operators.validators import first_reason

    t = table(spark, sf, "part").withColumn("before", F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    rules = [("MULTI_LINE", F.col("p_name").contains("\n")), ("EMPTY", F.trim("p_name") == ""), ("NEIGHBOUR", F.col("before") == F.col("p_name")), ("LONGER", F.length("p_name") > 1.5 * F.length("p_type"))]
    return first_reason(t, rules).select("p_partkey", "reason")


@query("tool_text_search", f"""WITH {LINES}, m AS (SELECT doc_id, ord FROM l WHERE contains(lower(text), 'tion')), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM m)
  SELECT doc_id, ord, n, total, total > 5 AS has_more, CASE WHEN total > 5 THEN 5 END AS next_offset FROM p WHERE n <= 5""")
def text_search(spark, sf):
    found = lines(table(spark, sf, "documents")).filter(F.lower("text").contains("tion")).select("doc_id", "ord")
    return W.page(found, ["doc_id"], ["ord"], 0, 5)


@query("tool_compare_lines", f"""WITH {LINES} SELECT a.doc_id, a.ord, length(b.text) - length(a.text) AS longer, b.ord - a.ord AS apart, lower(a.text) = lower(b.text) AS same FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.ord = 1 AND b.ord > 1""")
def compare_lines(spark, sf):
    l = lines(table(spark, sf, "documents"))  # noqa: E741
    a = l.filter("ord = 1").select("doc_id", "ord", F.col("text").alias("a"))
    b = l.filter("ord > 1").select("doc_id", F.col("ord").alias("o"), F.col("text").alias("b"))
    return a.join(b, "doc_id").select("doc_id", "ord", (F.length("b") - F.length("a")).alias("longer"), (F.col("o") - F.col("ord")).alias("apart"), (F.lower("a") == F.lower("b")).alias("same"))
