"""Documents as lines: the relational form that all other operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per line: doc_id, ord (from 1), alias (S0001 in reading order) and text. A null text has no line."""
    cut = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("at", "text"))
    return cut.select("doc_id", (F.col("at") + 1).alias("ord"), F.format_string("S%04d", F.col("at") + 1).alias("alias"), "text")


def units(lines_: DataFrame) -> DataFrame:
    """The catalog: lines with something in them, each with a span over the whole text."""
    return lines_.filter(F.length("text") > 0).select("doc_id", "ord", "alias", F.struct(F.lit(0).alias("start"), F.length("text").alias("end")).alias("span"), "text")
