"""Queries of the scalar functions, over headings made of the orders' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafolio.functions import text as T
from stratafolio.plans.registry import query
from stratafolio.session import table

#: Headings per customer, in SQL that Spark and DuckDB both read.
HEADINGS = """SELECT doc, ord, n, CASE CAST(ord % 8 AS INT) WHEN 0 THEN concat('Article ', n, ': Scope of ', lower(o_orderpriority)) WHEN 1 THEN concat('Chương ', roman, ' QUY ĐỊNH')
  WHEN 2 THEN concat('- Điều ', n, '. Thực hiện công việc') WHEN 3 THEN 'I think this is body text' WHEN 4 THEN concat(n, '.', n % 4 + 1, '. Kế hoạch tháng ', n % 12 + 1, '/2026 ... ', n)
  WHEN 5 THEN 'a) Chứng thực  bản sao' WHEN 6 THEN 'IIII. not a canonical number' ELSE concat(roman, '. Nhận xét: Bình thường;') END AS text
  FROM (SELECT o_custkey AS doc, o_orderkey AS ord, o_orderpriority, CAST(o_orderkey % 30 + 1 AS INT) AS n,
  concat(split_part('|X|XX|XXX', '|', CAST(floor((o_orderkey % 30 + 1) / 10) AS INT) + 1), split_part('|I|II|III|IV|V|VI|VII|VIII|IX', '|', CAST((o_orderkey % 30 + 1) % 10 AS INT) + 1)) AS roman FROM {orders}) AS o"""
H = "h AS (" + HEADINGS.format(orders="orders") + ")"
NAME = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(text), '(?i)^\s*(?:(?:" + T.LABELS + r")\s+(?:\d+(?:\.\d+)*|[IVXLC]+)\s*[.:)\-–]?\s+|\d+(?:\.\d+)*(?:[.:)\-–]\s+|\s+)|(?:[a-zA-Z]|[IVXLC]+)[.)]\s+)', ''), '[.:;, \t]+$', ''), '\s+', ' ', 'g')))"
ROMAN_SQL = " + ".join(f"(length(core) - length(replace(core, '{k}', ''))) // {len(k)} * {v}" for k, v in T.ROMAN_VALUES.items())


def headings(spark, sf):
    return spark.sql(HEADINGS, orders=table(spark, sf, "orders"))


@query("f_repeat_key", rf"""WITH {H} SELECT doc, ord, trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(text), '(?:\s*[.·…]){{2,}}', ' ', 'g'), '\s+', ' ', 'g')), '\s+\d+$', ''), '\d', '#', 'g')) AS key FROM h""")
def repeat_key(spark, sf):
    return headings(spark, sf).select("doc", "ord", T.repeat_key(F.col("text")).alias("key"))


@query("f_heading_key", rf"""WITH {H} SELECT doc, ord, {NAME} AS name, regexp_replace(regexp_replace({NAME}, '\b({T.DATES})\s+\d+(?:\s*/\s*\d+)*', '\1 #', 'g'), '\b\d{{1,2}}\s*/\s*\d{{4}}\b', '#', 'g') AS key FROM h""")
def heading_key(spark, sf):
    return headings(spark, sf).select("doc", "ord", T.heading_name(F.col("text")).alias("name"), T.heading_key(F.col("text")).alias("key"))


@query("f_sequence_key", rf"""WITH {H}, t AS (SELECT doc, ord, regexp_extract_all(regexp_replace(text, '^(?:[^\pL\pN\s]+\s+)+', ''), '\S+') AS w FROM h),
  e AS (SELECT doc, ord, w, unnest(w[1:4]) AS word, generate_subscripts(w[1:4], 1) AS i FROM t),
  c AS (SELECT *, regexp_replace(word, '^\(+', '') AS token, regexp_replace(regexp_replace(word, '^\(+', ''), '[.:);,]+$', '') AS core FROM e),
  v AS (SELECT *, substr(token, length(core) + 1) AS suffix, regexp_matches(core, '^\d{{1,4}}$') AS dec FROM c),
  n AS (SELECT *, CASE WHEN dec THEN core::INT WHEN (i > 1 OR suffix <> '') AND length(core) > 0 AND regexp_matches(core, '{T.ROMAN}') THEN {ROMAN_SQL} END AS value FROM v),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc, ord ORDER BY i) AS r FROM n WHERE value IS NOT NULL)
  SELECT doc, ord, CASE WHEN i > 1 THEN array_to_string(w[1:i - 1], ' ') || ' ' ELSE '' END || '#' || suffix AS key, value::INT AS value, CASE WHEN dec THEN 'decimal' ELSE 'roman' END AS form FROM f WHERE r = 1""")
def sequence_key(spark, sf):
    return headings(spark, sf).withColumn("k", T.sequence_key(F.col("text"))).filter("k IS NOT NULL").select("doc", "ord", "k.*")


RE2 = [(n, r, p.replace(r"(?!\d)", r"(?:$|\D)")) for n, r, p in T.MARKERS]  # DuckDB's patterns have no look-ahead
MARKER_SQL = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}:{r}:' || regexp_extract(text, '{p}', 1)" for n, r, p in RE2)


@query("d1_marker", rf"""WITH {H} SELECT doc, ord, CASE {MARKER_SQL} END AS marker FROM h""")
def marker(spark, sf):
    m = T.marker(F.col("text"))
    return headings(spark, sf).withColumn("m", m).select("doc", "ord", F.when(F.col("m").isNotNull(), F.concat_ws(":", "m.name", F.col("m.rank").cast("string"), "m.number")).alias("marker"))


@query("f_folded", rf"""WITH {H} SELECT doc, ord, regexp_replace(lower(strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D'))), '\s', '', 'g') AS key FROM h""")
def folded(spark, sf):
    return headings(spark, sf).select("doc", "ord", T.folded("text").alias("key"))


@query("d17_doubled", """WITH l AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[^\\pL]', '', 'g'), '') AS t FROM documents)
  SELECT doc_id, len(list_filter(list_zip(t[:-2], t[2:]), lambda p: p[1] = p[2])) / (len(t) - 1)::DOUBLE AS share FROM l WHERE len(t) >= 12""")
def d17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.doubled_share(F.col("text")).alias("share")).filter("share IS NOT NULL")


@query("sc3_content_hash", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::INT AS bytes FROM documents")
def sc3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").alias("bytes"))


@query("f_signature", "SELECT c_custkey, sha256(concat_ws(chr(31), c_name, c_mktsegment, c_nationkey::VARCHAR)) AS signature FROM customer")
def signature(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.sha2(F.concat_ws(chr(31), "c_name", "c_mktsegment", F.col("c_nationkey").cast("string")).cast("binary"), 256).alias("signature"))


@query("f_edit_distance", "SELECT p_partkey, levenshtein(p_name, p_type) AS distance, CASE WHEN levenshtein(p_name, p_type) > 8 THEN -1 ELSE levenshtein(p_name, p_type) END AS bounded FROM part")
def edit_distance(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"), F.levenshtein("p_name", "p_type", 8).alias("bounded"))


@query("a3_word_tokens", r"""SELECT doc_id, len(regexp_extract_all(text, '[\pL\pM\pN]+|[^\pL\pM\pN\s]')) AS tokens FROM documents""")
def a3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]")).alias("tokens"))


@query("f_line_forms", r"""SELECT doc_id, len(regexp_replace(lower(text), '\s+', '', 'g')) AS compact, md5(regexp_replace(lower(text), '[^\pL\pN]+', '', 'g')) AS skeleton,
  regexp_replace(regexp_replace(regexp_replace(substr(text, 1, 40), '\pN+', '#', 'g'), '\p{Ll}+', 'a', 'g'), '\p{Lu}+', 'A', 'g') AS kind, regexp_extract(text, '^\s*(\S*?)[.,:;)]*(?:\s|$)', 1) AS leading, regexp_extract(text, '([.,:;!?…]+)[\s"''”’)]*$', 1) AS ending FROM documents""")
def line_forms(spark, sf):
    t = F.col("text")
    out = table(spark, sf, "documents")
    return out.select("doc_id", F.length(T.compact(t)).alias("compact"), F.md5(T.skeleton(t).cast("binary")).alias("skeleton"), T.label_kind(F.substring(t, 1, 40)).alias("kind"), T.leading_token(t).alias("leading"), T.ending_punctuation(t).alias("ending"))


@query("f_heading_label", rf"""WITH {H} SELECT doc, ord, nullif(trim(regexp_replace(regexp_replace(regexp_extract(lower(text), '^\s*(chương|mục|điều|phần)\s+([ivxlcdm]+|\d+)(?:$|[^\pL\pN_])', 0), '[^\pL\pN]+$', ''), '\s+', ' ', 'g')), '') AS label FROM h""")
def heading_label(spark, sf):
    return headings(spark, sf).select("doc", "ord", T.heading_label(F.col("text")).alias("label"))


@query("f_similarity", "SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE, 9) AS similarity FROM part")
def similarity(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(T.similarity(F.col("p_name"), F.col("p_type")), 9).alias("similarity"))


@query("d19_numerals", """WITH n AS (SELECT o_orderkey, (o_orderkey % 3999 + 1)::INT AS n FROM orders) SELECT o_orderkey, repeat('M', n // 1000) || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[n // 100 % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[n // 10 % 10 + 1]
  || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1] AS roman, n AS value, repeat(chr(97 + (n % 60) % 26), (n % 60) // 26 + 1) AS letters FROM n""")
def numerals(spark, sf):
    o = table(spark, sf, "orders").withColumn("n", (F.col("o_orderkey") % 3999 + 1).cast("int"))
    return o.select("o_orderkey", T.roman(F.col("n")).alias("roman"), T.roman_value(T.roman(F.col("n"))).alias("value"), T.letters(F.col("n") % 60 + 1).alias("letters"))


@query("f_path_parts", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, '/body' || repeat('/tbl[' || l_linenumber || ']/tr[' || l_partkey % 5 || ']/tc[1]', (l_partkey % 3)::INT) || CASE WHEN l_suppkey % 7 = 0 THEN '/txbxContent' ELSE '' END || '/p[' || l_suppkey || ']' AS p FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, p, len(regexp_extract_all(p, '/tbl\\[')) AS depth, nullif(regexp_extract(p, '^(.*/tbl\\[\\d+\\])', 1), '') AS "table", nullif(regexp_extract(p, '^(.*/tr\\[\\d+\\])', 1), '') AS "row", nullif(regexp_extract(p, '^(.*/tc\\[\\d+\\])', 1), '') AS cell, contains(p, '/txbxContent') AS text_box FROM l""")
def path_parts(spark, sf):
    step = F.concat(F.lit("/tbl["), F.col("l_linenumber"), F.lit("]/tr["), F.col("l_partkey") % 5, F.lit("]/tc[1]"))
    p = F.concat(F.lit("/body"), F.repeat(step, (F.col("l_partkey") % 3).cast("int")), F.when(F.col("l_suppkey") % 7 == 0, "/txbxContent").otherwise(""), F.lit("/p["), F.col("l_suppkey"), F.lit("]"))
    return table(spark, sf, "lineitem").withColumn("p", p).withColumn("x", T.path_parts(F.col("p"))).select("l_orderkey", "l_linenumber", "l_partkey", "p", "x.*")


@query("f_repaired", r"""SELECT p_partkey, replace(regexp_replace(trim(regexp_replace(p_name, '\s+', ' ', 'g')), '\s+([.,;:!?)\]])', '\1', 'g'), '( ', '(') AS text FROM part""")
def repaired(spark, sf):
    """Names of parts, with blanks put before full stops and single letters set apart; repaired, they are as before."""
    t = F.concat(F.lit("( "), F.col("p_name"), F.lit(" ) ."))
    return table(spark, sf, "part").select("p_partkey", F.regexp_extract(T.repaired(t), r"^\((.*)\)\.$", 1).alias("text"))


@query("f_json_field", """SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract_string(props, '$.k') END AS value, CASE WHEN NOT json_valid(props) THEN 'NOT_JSON' WHEN json_type(props, '$.k') IS NULL THEN 'MISSING' WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'OK' ELSE 'WRONG_KIND' END AS state FROM events""")
def json_field(spark, sf):
    return table(spark, sf, "events").withColumn("x", T.json_field(F.col("props"), "k", "number")).select("event_id", "x.*")
