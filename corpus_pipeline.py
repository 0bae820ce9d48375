"""A training-data pipeline over ``documents``: quality rules, near-dedup, secret scan, mixing, BPE encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
documents. All but the last return the columns of documents.

Every stage takes whole texts of any length, an empty table (and returns one), nulls in any column, and columns beyond those of
documents, whose names may be any but those that begin with ``__sf_``. What becomes of nulls, repeated rows and ties is said with
each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafolio.llm import bpe, mixing, quality, secrets, simhash
from stratafolio.llm._shared import written

BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of at most ``BATCH_ROWS``: an executor that has run every stage before has a full heap, and
    Arrow's buffers, outside it, grow with a batch's texts. A smaller setting of the session stays."""
    if int(spark.conf.get(BATCH_SETTING)) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the text rules or lose most words to lines that many documents of their source share. A null or empty
    text has no words and goes; a null source is a source; repeated rows share a verdict; nothing is ranked, so there are no ties."""
    small_batches(spark)
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies (five-word shingles, similarity 0.8 or more): that with the smallest
    id, null last, and of rows with one id the one that stands first. Null, empty and blank texts are copies of one another."""
    small_batches(spark)
    return simhash.without_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every row stays, null and empty texts as they are. Spans that overlap are replaced by one mark."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins documents so that the sources weigh 5, 2, 1 in turn; a document may stand up to three times. A null source is
    the last one; null and empty texts have size 0; rows that agree in id and text share a draw."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (unsigned 32-bit little-endian integers as bytes), and digests of them and of what they decode to. A
    null or empty text has no ids; repeated rows each have a row; a null id stays null."""
    small_batches(spark)
    out = bpe.encoded(docs, VOCABULARY)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("secret scans", secret_scan), ("mixing", mix_sources), ("BPE encoding", encode)]

#: Hashes of words and shingles (XXH3, XXH64) and byte-level merges have no DuckDB counterpart; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
