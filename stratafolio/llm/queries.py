"""One query per operator of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from stratafolio.llm import bpe, chunks, langid, mixing, quality, secrets, simhash, tokenbin, topk, warc
from stratafolio.session import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 by source."""
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE_OP1 = r"""
WITH words AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS own FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM words GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sizes),
caps AS (SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total FROM ranked),
open AS (SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM caps),
marked AS (SELECT *, weight * rest > cap * open_weight AS capped FROM open),
summed AS (SELECT *, coalesce(sum(cap) FILTER (capped) OVER (), 0) AS capped_sum, sum(weight) FILTER (NOT capped) OVER () AS free_weight FROM marked),
plan AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * (total - capped_sum) / free_weight END AS target FROM summed),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate FROM plan),
drawn AS (SELECT w.doc_id, w.size, r.source_size, r.target, w.source,
  (floor(rate) + CASE WHEN ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || own), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM words w JOIN rates r ON w.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM drawn
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives with revisits, and read back."""
    manifest = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_warc(spark, manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")


ORACLE_OP2 = r"""
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to, url AS target_uri
FROM g
"""

def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.topk(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


ORACLE_OP3 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and the verdict of the line-frequency rule for all documents."""
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


ORACLE_OP4 = r"""
WITH w AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS t FROM documents),
raw AS (SELECT doc_id, source, md5(t) AS t, unnest(string_split(t, chr(10))) AS raw FROM w),
cut AS (SELECT *, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS lw FROM raw),
line AS (SELECT doc_id, source, t, raw, len(lw) AS words, ('0x' || substr(md5(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), 1, 15))::BIGINT AS h
  FROM cut WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS dup FROM line GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT coalesce(text, '')) AS n FROM documents GROUP BY source),
common AS (SELECT l.source, h FROM line l JOIN hosts k ON l.source IS NOT DISTINCT FROM k.source GROUP BY l.source, h, n
  HAVING count(DISTINCT t) > greatest(10, 0.01::DOUBLE * n)),
removed AS (SELECT doc_id, sum(words)::BIGINT AS removed FROM line l JOIN common c ON l.h = c.h AND l.source IS NOT DISTINCT FROM c.source GROUP BY doc_id),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM windows),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(f.dup, 0)::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(r.removed, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN dup f USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN removed r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT 100 * removed_words > 50 * n_words AS kept, removed_words FROM b
"""

def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: three patterns, and what the Markov models add."""
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three pattern kinds of op5 alone, which SQL can express."""
    return secrets.base_scan(table(spark, sf_dir, "documents"))


ORACLE_SECRETS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, 0 AS k, regexp_extract_all(t, p) AS f, string_split_regex(t, p) AS b FROM d, (SELECT $$(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+$$ AS p)
  UNION ALL SELECT doc_id, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 2, regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM d),
u AS (SELECT doc_id, k, unnest(range(1, len(f) + 1)) AS i, unnest(f) AS x, unnest(b[1:len(f)]) AS gap FROM m WHERE len(f) > 0),
p AS (SELECT doc_id, k, x, sum(length(gap) + length(x)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM u),
s AS (SELECT doc_id, k, (e - length(x))::BIGINT AS a, e::BIGINT AS e FROM p
  WHERE CASE k WHEN 0 THEN length(regexp_extract(x, $$^[A-Za-z_]+["']? *[:=] *["']?(.*)$$, 1)) >= 6 WHEN 1 THEN length(x) >= 20 ELSE length(x) >= 24 END),
l AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg((['assign', 'access', 'hex'])[k + 1] || ':' || a || ':' || e, ',' ORDER BY a, k) AS listed FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256
FROM documents LEFT JOIN l USING (doc_id)
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those at most 3 bits apart."""
    return simhash.simhash(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by merge replay, and decoded."""
    out = bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written to binary files in the order of their ids, and read back."""
    parts = tokenbin.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenbin.read_ids(parts).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that occurred before."""
    return chunks.repeated(table(spark, sf_dir, "documents")).select("doc_id", "first_doc_id", "start_byte", "end_byte", "n_words", "n_chunks")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_mix": op1_mix, "op2_warc": op2_warc, "op3_topk": op3_topk, "op4_quality": op4_quality, "op5_secrets": op5_secrets, "secrets_base": secrets_base, "op6_simhash": op6_simhash, "op7_bpe": op7_bpe, "op8_langid": op8_langid, "op9_chunks": op9_chunks, "op10_tokenbin": op10_tokenbin, "pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"op1_mix": ORACLE_OP1, "op2_warc": ORACLE_OP2, "op3_topk": ORACLE_OP3, "op4_quality": ORACLE_OP4, "secrets_base": ORACLE_SECRETS}
