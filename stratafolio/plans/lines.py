"""Queries of sources and sinks: documents as lines and units, and the outline in its written forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratafolio.plans.registry import query
from stratafolio.session import table
from stratafolio.sources.lines import lines, units

LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)"


@query("pr2_lines", f"WITH {LINES} SELECT doc_id, ord, printf('S%04d', ord) AS alias, length(text) AS chars FROM l")
def pr2(spark, sf):
    return lines(table(spark, sf, "documents")).select("doc_id", "ord", "alias", F.length("text").alias("chars"))


@query("pr1_units", f"WITH {LINES} SELECT doc_id, ord, printf('S%04d', ord) AS alias, 0 AS start, length(text) AS end FROM l WHERE length(text) > 0")
def pr1(spark, sf):
    return units(lines(table(spark, sf, "documents"))).select("doc_id", "ord", "alias", "span.start", "span.end")


@query("pr3_context", f"""WITH {LINES} SELECT doc_id, ord, coalesce(array_to_string(list(substr(text, 1, 10)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '|'), '') AS before,
  length(text) <= 180 AS short FROM l""")
def pr3(spark, sf):
    from stratafolio.operators.windows import neighbours

    out = neighbours(lines(table(spark, sf, "documents")).withColumn("e", F.substring("text", 1, 10)), ["doc_id"], "ord", "e", 3)
    return out.select("doc_id", "ord", F.array_join("before", "|").alias("before"), (F.length("text") <= 180).alias("short"))


TREE = """SELECT r_name AS path, 1 AS level, r_name AS text FROM {region} UNION ALL SELECT concat(r_name, '/', n_name), 2, n_name FROM {nation} n JOIN {region} r ON n_regionkey = r_regionkey"""


@query("sk1_outline_formats", f"""WITH t AS ({TREE.format(region='region', nation='nation')}) SELECT path, repeat(' ', 2 * (level - 1)) || '- ' || text AS markdown, repeat(' ', 4 * (level - 1)) || text AS plain,
  '<heading level="' || level || '">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</heading>' AS xml, CASE WHEN regexp_matches(text, '[",\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || level AS csv FROM t""")
def sk1(spark, sf):
    from stratafolio.sources.outline import formatted

    tree = spark.sql(TREE, region=table(spark, sf, "region"), nation=table(spark, sf, "nation"))
    return formatted(tree, "level", "text").select("path", "markdown", "plain", "xml", "csv")


@query("sk2_latest_version", """SELECT user_id AS name, arg_max(event_id, ts) AS latest, count(*) AS revisions FROM events GROUP BY user_id""")
def sk2(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("name")).agg(F.max_by("event_id", "ts").alias("latest"), F.count(F.lit(1)).alias("revisions"))


@query("w20_block_cosine", rf"""WITH {LINES}, w AS (SELECT DISTINCT doc_id, ord, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM l),
  s AS (SELECT doc_id, ord AS gap, word, 0 AS side FROM w UNION SELECT doc_id, ord + 1, word, 0 FROM w UNION SELECT doc_id, ord - 1, word, 1 FROM w UNION SELECT doc_id, ord - 2, word, 1 FROM w),
  c AS (SELECT doc_id, gap, word, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM s GROUP BY ALL)
  SELECT doc_id, gap, round(sum(a * b) / nullif(sqrt(sum(a * a)::DOUBLE) * sqrt(sum(b * b)::DOUBLE), 0), 6) AS cosine FROM c GROUP BY doc_id, gap HAVING sum(a) > 0 AND sum(b) > 0""")
def w20(spark, sf):
    from stratafolio.operators.segments import block_cosine

    return block_cosine(lines(table(spark, sf, "documents")), 2)
