"""The outline's written forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def formatted(outline: DataFrame, level: str, text: str) -> DataFrame:
    """Adds a row's Markdown, plain text, XML and CSV form; an ordered write of one column is the file."""
    t, n = F.col(text), F.col(level)
    escaped = F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    quoted = F.when(t.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)
    indent = lambda k: F.expr(f"repeat(' ', {k} * (`{level}` - 1))")
    return outline.withColumns({
        "markdown": F.concat(indent(2), F.lit("- "), t), "plain": F.concat(indent(4), t),
        "xml": F.concat(F.lit('<heading level="'), n.cast("string"), F.lit('">'), escaped, F.lit("</heading>")), "csv": F.concat(quoted, F.lit(","), n.cast("string")),
    })


def compact_view(columns: list[str]) -> Column:
    """The columns as one JSON object without white space; nulls are left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def write_outline(outline: DataFrame, folder: str, kind: str, order: str, level: str, text: str) -> None:
    """Writes an outline in one of five forms (json, markdown, plain, xml, csv), in order. An outline is one document's: its rows go
    to one file, sorted, and the elements of XML have no enclosing one."""
    if kind == "json":
        rows = outline.select(F.to_json(F.struct(order, level, text)).alias("value"), F.col(order).alias("at"))
    else:
        rows = formatted(outline, level, text).select(F.col(kind).alias("value"), F.col(order).alias("at"))
    rows.coalesce(1).sortWithinPartitions("at").select("value").write.text(folder)


def save_version(outline: DataFrame, folder: str, name: str, version: int) -> None:
    """Adds a version of an outline to a store: versions are folders and never change; one that is there already is an error."""
    outline.write.parquet(f"{folder}/name={name}/version={version}")


def stored(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of every stored outline: each at its latest version, or at the latest up to ``version``."""
    rows = spark.read.parquet(folder)
    if version is not None:
        rows = rows.filter(F.col("version") <= version)
    newest = rows.groupBy("name").agg(F.max("version").alias("version"))
    return rows.join(newest, ["name", "version"], "left_semi")


def appended(events: DataFrame, folder: str) -> None:
    """Adds events to a store of JSON lines; files are only added, and a failed write leaves none behind."""
    events.write.mode("append").json(folder)


def claims(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The entries of an array in JSON files (one document each), one row an entry, with the file and their place in it. Files that
    aren't JSON, or lack the array, have one row without an entry and ``broken``."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"{field} array<{schema}>").alias("x"))
    entries = raw.select("file", F.col(f"x.{field}").isNull().alias("broken"), F.posexplode_outer(f"x.{field}").alias("at", "entry"))
    return entries.select("file", "broken", "at", "entry.*")


def cached(spark: SparkSession, source: DataFrame, folder: str, code: str, make: Callable[[DataFrame], DataFrame], *, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """What ``make`` finds in files (path, content), kept in a Parquet store under the hash of their bytes and the version of the code:
    only files whose bytes that version hasn't seen are read again. ``make`` keeps the columns path and content_hash."""
    hashed = source.withColumn("content_hash", F.sha2(content_col, 256))
    have = f"{folder}/code={code}"
    try:
        known = spark.read.parquet(have)
    except AnalysisException:
        known = None
    new = hashed if known is None else hashed.join(known.select("content_hash").distinct(), "content_hash", "left_anti")
    make(new.dropDuplicates(["content_hash"])).write.mode("append").parquet(have)
    return spark.read.parquet(have).drop(path_col).join(hashed.select(path_col, "content_hash"), "content_hash")
