"""Queries of the model-free outline and of merging by heading."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafolio.operators import outline as O  # noqa: N812
from stratafolio.operators import trees
from stratafolio.plans import scalars
from stratafolio.plans.lines import LINES
from stratafolio.plans.registry import query
from stratafolio.plans.scalars import MARKER_SQL
from stratafolio.plans.scalars import H as HEADINGS_SQL
from stratafolio.plans.trees import H, headings
from stratafolio.session import table
from stratafolio.sources.lines import lines


@query("d5_format_score", rf"""WITH {LINES}, a AS (SELECT *, coalesce(lead(length(text)) OVER (PARTITION BY doc_id ORDER BY ord), 0) AS after, trim(text) AS t FROM l)
  SELECT doc_id, ord, round((CASE WHEN length(text) % 13 > 10 THEN 0.45 ELSE 0 END + CASE WHEN length(text) % 2 = 0 THEN 0.35 ELSE 0 END + CASE WHEN regexp_matches(t, '^\d+(\.\d+)+') THEN 0.45 ELSE 0 END + CASE WHEN length(t) <= 90 THEN 0.12 ELSE 0 END
  + CASE WHEN NOT regexp_matches(t, '[.!?;,]$') THEN 0.12 ELSE 0 END + CASE WHEN upper(t) = t AND lower(t) <> t AND length(t) > 6 THEN 0.15 ELSE 0 END + CASE WHEN after > 200 AND length(t) < 90 THEN 0.15 ELSE 0 END)::DOUBLE, 2) AS score, score >= 0.62 AS candidate FROM a""")
def d5(spark, sf):
    l = lines(table(spark, sf, "documents")).withColumn("size", F.length("text") % 13).withColumn("bold", F.length("text") % 2 == 0)  # noqa: E741
    return O.format_score(l, ["doc_id"], "ord", "text", "size", "bold", F.lit(10), F.lit(False)).select("doc_id", "ord", "score", "candidate")


KEYWORD_SQL = O.KEYWORD.replace("(?iu)", "(?i)")
CAPTION_SQL = O.CAPTION.replace("(?iu)", "(?i)")


@query("d4_candidate", rf"""WITH {HEADINGS_SQL}, m AS (SELECT doc, ord, text, CASE {MARKER_SQL} END AS m FROM h)
  SELECT doc, ord, CASE WHEN regexp_matches(text, '{CAPTION_SQL}') THEN NULL WHEN m IS NOT NULL THEN 'MARKER' WHEN regexp_matches(text, '{KEYWORD_SQL}') THEN 'KEYWORD' WHEN doc % 5 = 0 THEN 'STYLE'
  WHEN ord % 3 = 0 AND ord % 2 = 0 THEN 'CENTRED' WHEN ord % 2 = 0 THEN 'BOLD' END AS why FROM m""")
def d4(spark, sf):
    h = scalars.headings(spark, sf).withColumn("style", F.when(F.col("doc") % 5 == 0, "Heading 1"))
    why = O.candidate(F.col("text"), style=F.col("style"), bold=F.col("ord") % 2 == 0, centred=F.col("ord") % 3 == 0, body_bold=F.lit(False))
    return h.select("doc", "ord", why.alias("why"))


@query("d6_body_baseline", f"""WITH {LINES}, g AS (SELECT doc_id, length(text) % 4 AS v, count(*) AS n, min(ord) AS f FROM l WHERE length(text) > 200 GROUP BY ALL) SELECT doc_id, v AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS r FROM g) WHERE r = 1""")
def d6(spark, sf):
    return O.body_baseline(lines(table(spark, sf, "documents")).withColumn("v", F.length("text") % 4), ["doc_id"], "ord", "v", F.length("text") > 200)


@query("d7_repeated_flag", f"""WITH {LINES} SELECT doc_id, ord, count(*) OVER (PARTITION BY doc_id, lower(text)) > 2 AS repeated FROM l""")
def d7(spark, sf):
    return lines(table(spark, sf, "documents")).select("doc_id", "ord", F.expr("count(1) OVER (PARTITION BY doc_id, lower(text)) > 2").alias("repeated"))


INLINE_SQL = O.INLINE_LABEL.replace("(?iu)", "(?i)")


@query("d7_confidence", rf"""WITH {HEADINGS_SQL}, k AS (SELECT *, count(*) OVER (PARTITION BY doc, lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS times, CASE {MARKER_SQL} END IS NOT NULL AS marked, regexp_matches(text, '{INLINE_SQL}') AS inl FROM h)
  SELECT doc, ord, greatest(round((CASE WHEN marked THEN 0.9 ELSE 0.7 END - CASE WHEN length(text) > 120 THEN 0.1 ELSE 0 END - CASE WHEN times > 2 THEN 0.2 ELSE 0 END - CASE WHEN inl THEN 0.25 ELSE 0 END - CASE WHEN ord % 4 = 0 THEN 0.15 ELSE 0 END)::DOUBLE, 2), 0) AS confidence,
  list_filter([CASE WHEN length(text) > 120 THEN 'needs_split' END, CASE WHEN times > 2 THEN 'repeat_x' || times END, CASE WHEN inl THEN 'inline_label' END, CASE WHEN ord % 4 = 0 THEN 'in_table' END, CASE WHEN marked AND doc % 5 = 0 THEN 'marker_over_style' END], lambda x: x IS NOT NULL) AS flags FROM k""")
def d7_confidence(spark, sf):
    h = scalars.headings(spark, sf)
    return O.confidence(h, ["doc"], "text", "text", in_table=F.col("ord") % 4 == 0, style=F.col("doc") % 5 == 0).select("doc", "ord", "confidence", "flags")


@query("d8_format_rank", """SELECT o_custkey, o_orderkey, 20 + dense_rank() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 50000) DESC, (o_orderstatus = 'F') DESC) AS rank FROM orders""")
def d8(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / 50000).alias("size"), (F.col("o_orderstatus") == "F").alias("bold"))
    return O.format_rank(o, ["o_custkey"], "size", "bold").select("o_custkey", "o_orderkey", "rank")


@query("d9_levels_of_ranks", f"""WITH RECURSIVE {H}, k AS (SELECT doc, ord, CASE WHEN id % 19 <> 0 THEN id * 5 % 8 END AS rank FROM n), e AS (SELECT *, sum((rank IS NULL)::INT) OVER (PARTITION BY doc ORDER BY ord) AS era, coalesce(rank, -1) AS r FROM k),
  p AS (SELECT c.doc, c.ord, max(p.ord) AS up FROM e c LEFT JOIN e p ON p.doc = c.doc AND p.era = c.era AND p.ord < c.ord AND p.r < c.r GROUP BY ALL),
  t AS (SELECT doc, ord, 1 AS level FROM p WHERE up IS NULL UNION ALL SELECT p.doc, p.ord, t.level + 1 FROM p JOIN t ON p.doc = t.doc AND p.up = t.ord) SELECT doc, ord, least(level, 9) AS level FROM t""")
def d9(spark, sf):
    h = headings(spark, sf).select("doc", "ord", F.when(F.col("id") % 19 != 0, F.col("id") * 5 % 8).alias("rank"))
    return O.levels_of_ranks(h, ["doc"], "ord", "rank").select("doc", "ord", "level")


@query("d11_sequence_gaps", f"""WITH {H}, l AS (SELECT doc, level, ord, id % 5 AS v, lag(id % 5) OVER (PARTITION BY doc, level ORDER BY ord) + 1 AS expected FROM n) SELECT doc, ord, expected, v FROM l WHERE expected IS NOT NULL AND v <> expected""")
def d11(spark, sf):
    return O.sequence_gaps(headings(spark, sf).withColumn("v", F.col("id") % 5), ["doc", "level"], "ord", "v").select("doc", "ord", "expected", "v")


@query("d12_asymmetry", f"""WITH {LINES}, m AS (SELECT doc_id, list(length(text) ORDER BY length(text))[(count(*) // 2 + 1)::INT] AS middle FROM l GROUP BY doc_id HAVING count(*) >= 3) SELECT doc_id, ord, length(text) AS n, middle FROM l JOIN m USING (doc_id) WHERE length(text) > 3 * greatest(middle, 1)""")
def d12(spark, sf):
    l = lines(table(spark, sf, "documents")).select("doc_id", "ord", F.length("text").alias("n"))  # noqa: E741
    return O.asymmetry(l, ["doc_id"], "n")


@query("d13_document_kind", rf"""WITH {LINES}, c AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(text, '^\s*\d+[.)]\s')) AS numbered, count(*) FILTER (length(text) > 200) AS long, count(*) FILTER (length(text) > 0 AND length(text) <= 40) AS short,
  count(*) FILTER (regexp_matches(text, '[#*$%&|]{{3,}}')) AS junk, sum(length(text))::BIGINT AS chars FROM l GROUP BY doc_id)
  SELECT *, CASE WHEN 2 * junk >= lines THEN 'damaged' WHEN 3 * numbered >= lines THEN 'numbered' WHEN 2 * short >= lines THEN 'list' WHEN 2 * long >= lines THEN 'prose' ELSE 'mixed' END AS kind FROM c""")
def d13(spark, sf):
    return O.document_kind(lines(table(spark, sf, "documents")), ["doc_id"], "text")


@query("d14_toc_ratio", f"""WITH {LINES}, t AS (SELECT DISTINCT doc_id % 20 AS d, lower(text) AS k FROM l WHERE ord = 1), b AS (SELECT DISTINCT doc_id % 20 AS d, lower(text) AS k FROM l WHERE ord > 1) SELECT t.d, count(b.k) / count(*)::DOUBLE AS ratio FROM t LEFT JOIN b ON t.d = b.d AND t.k = b.k GROUP BY t.d""")
def d14(spark, sf):
    l = lines(table(spark, sf, "documents")).select((F.col("doc_id") % 20).alias("d"), F.lower("text").alias("k"), "ord")  # noqa: E741
    body = l.filter("ord > 1").select("d", "k").distinct().withColumn("found", F.lit(1))
    return l.filter("ord = 1").select("d", "k").distinct().join(body, ["d", "k"], "left").groupBy("d").agg((F.count("found") / F.count(F.lit(1))).alias("ratio"))


@query("d15_style_depth", f"""WITH {H}, c AS (SELECT doc, level, id % 3 AS style, count(*) AS n FROM n GROUP BY ALL), s AS (SELECT doc, style, max(n) / sum(n)::DOUBLE AS share FROM c GROUP BY doc, style) SELECT doc, round(avg(share), 6) AS consistency FROM s GROUP BY doc""")
def d15(spark, sf):
    c = headings(spark, sf).groupBy("doc", "level", (F.col("id") % 3).alias("style")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("doc", "style").agg((F.max("n") / F.sum("n")).alias("share")).groupBy("doc").agg(F.round(F.avg("share"), 6).alias("consistency"))


@query("m1_place_by_chain", f"""WITH RECURSIVE {H}, p AS (SELECT c.doc, c.ord, 'n' || (c.id % 4) AS name, max(p.ord) AS parent FROM n c LEFT JOIN n p ON p.doc = c.doc AND p.ord < c.ord AND p.level < c.level GROUP BY c.doc, c.ord, c.id),
  r AS (SELECT doc, ord, name AS chain FROM p WHERE parent IS NULL UNION ALL SELECT p.doc, p.ord, r.chain || ' > ' || p.name FROM p JOIN r ON p.doc = r.doc AND p.parent = r.ord),
  t AS (SELECT doc // 2 AS pair, chain, count(*) AS n, min(ord) AS target FROM r WHERE doc % 2 = 0 GROUP BY ALL)
  SELECT doc, ord, CASE WHEN n IS NULL THEN 'NEW' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'EXACT' END AS status, CASE WHEN n = 1 THEN target END AS target FROM (SELECT *, doc // 2 AS pair FROM r WHERE doc % 2 = 1) s LEFT JOIN t USING (pair, chain)""")
def m1(spark, sf):
    h = headings(spark, sf).withColumn("name", F.concat(F.lit("n"), (F.col("id") % 4).cast("string")))
    c = trees.chains(h, ["doc"], "ord", "level", "name").withColumn("pair", F.floor(F.col("doc") / 2))
    out = O.place_by_chain(c.filter("doc % 2 = 1").select("doc", "ord", "pair", "chain"), c.filter("doc % 2 = 0").select("pair", "chain", "ord"), ["pair"], "chain", "ord")
    return out.select("doc", "ord", "status", "target")
