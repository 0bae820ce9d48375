"""Substring dedup by content-defined chunks: a gear rolling hash cuts texts where their content says so, chunks that occur
again are found by digest, and an insertion moves only the cuts beside it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafolio.llm._shared import written

#: The hash of a place has 16 bits, so it depends on the 16 bytes up to it.
WINDOW = 16
#: A place is a cut if its hash is the least within so many bytes on either side; without any, a chunk ends after MOST bytes.
REACH, MOST = 24, 2048
#: Bytes that are hashed at once.
PIECE = 1 << 22
CHUNKS = "d0 long, d1 long, place long, row long, doc_id long, text_hash long, again boolean"
#: Whether a byte belongs to a word.
SOLID = np.array([x not in b" \t\n\v\f\r" for x in range(256)])
#: The gear table by rule: XXH32 of each byte, its low half.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) & 0xFFFF for b in range(256)], dtype=np.uint16)
#: A null id comes after all others.
LAST = (1 << 63) - 1


def gear(raw: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[raw[i]] modulo 2**16 for all places: the sum over the 16 bytes up to i, by doubling the window."""
    h, width = GEAR[raw], 1
    while width < WINDOW:
        more = h.copy()
        more[width:] += h[:-width] << np.uint16(width)
        h, width = more, 2 * width
    return h


def _least_after(h: np.ndarray) -> np.ndarray:
    """The least of the REACH values after each place, by doubling the reach; beyond the end nothing is less."""
    end = np.full(REACH, 0x10000, np.uint32)
    out, width = np.concatenate([h[1:], end]), 1
    while width < REACH:
        more = min(width, REACH - width)
        out = np.minimum(out, np.concatenate([out[more:], end[:more]]))
        width += more
    return out[: len(h)]


def cuts(data: bytes) -> np.ndarray:
    """Where the chunks of a text begin, and its end. Whether a place is a cut depends on the REACH bytes on either side and the
    WINDOW bytes before them (but for cuts forced by MOST), so equal passages are cut alike but for their ends, and cuts are
    more than REACH bytes apart."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(data), PIECE):
        lead = min(at, REACH + WINDOW)
        h = gear(np.frombuffer(data, np.uint8)[at - lead : at + PIECE + REACH]).astype(np.uint32)
        least = (h <= _least_after(h)) & (h < _least_after(h[::-1])[::-1])
        own = np.flatnonzero(least[lead : lead + PIECE]) + at + 1
        found.append(own[own < len(data)])
    bounds = np.concatenate([[0], *found, [len(data)]]).astype(np.int64)
    wide = np.flatnonzero(np.diff(bounds) > MOST)
    if len(wide):
        bounds = np.unique(np.concatenate([bounds, *(np.arange(bounds[i], bounds[i + 1], MOST) for i in wide)]))
    return np.unique(bounds)


def chunk_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """A row per chunk: digest (128 bits, d0 and d1), place (start << 24 | size << 12 | words that begin in it, in bytes of UTF-8),
    row, doc_id, text_hash, and whether the same text has the chunk already (again). A null or empty text has none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k) for k in ("row", "doc_id", "text_hash")]
            held, n = [], 0
            for i, text in enumerate(batch.column("text").cast(pa.large_binary())):
                if not (data := text.as_py()):
                    continue
                b = cuts(data)
                ends = b.tolist()
                solid = SOLID[np.frombuffer(data, np.uint8)]
                begins = solid & ~np.r_[False, solid[:-1]]
                words = np.add.reduceat(begins.astype(np.int64), b[:-1])
                own = [xxhash.xxh3_128_digest(data[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
                seen: set[bytes] = set()
                again = np.array([x in seen or seen.add(x) is not None for x in own])
                held.append((np.frombuffer(b"".join(own), np.int64).reshape(-1, 2), b[:-1] << 24 | np.diff(b) << 12 | words, np.full(len(own), i), again))
                n += len(own)
                if n > 50_000:
                    yield _packed(held, keys)
                    held, n = [], 0
            if held:
                yield _packed(held, keys)

    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    text = F.col(text_col).cast("string")
    chosen = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return chosen.mapInArrow(task, CHUNKS)


def _packed(held: list[tuple], keys: list[pa.Array]) -> pa.RecordBatch:
    digests, places, index, again = (np.concatenate(x) for x in zip(*held, strict=True))
    columns = [pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array(places), *(k.take(pa.array(index)) for k in keys), pa.array(again)]
    return pa.RecordBatch.from_arrays(columns, ["d0", "d1", "place", "row", "doc_id", "text_hash", "again"])


def repeated(docs: DataFrame, *, min_words: int = 24, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Passages to remove: maximal runs of chunks that occurred before, in an earlier document or earlier in the same text.

    Documents are ordered by id (null last), then by the text's hash, and only rows that agree in both by their place in the
    table, so the outcome doesn't depend on how the table is dealt. One row per run of at least ``min_words`` words: row, doc_id,
    start_byte, end_byte, n_words, first_doc_id (the smallest id among the documents that keep the run's chunks; null if none
    has one), n_chunks. Texts without such a run, null and empty ones among them, have no row, nor has an empty table. Only the
    columns named are read. A passage loses up to a chunk and 40 bytes at its beginning and a chunk and 24 bytes at its end, so
    50 words show as a run of some 38. Passages of one word repeated have no least hash to cut at, and may be missed.

    The first holder of a digest is found by an aggregation that combines on the map side; the join that leads back to a digest
    held by a third of the documents is one whose hot keys AQE splits. Runs are formed per text.
    """
    occurrences = written(chunk_rows(docs, id_col=id_col, text_col=text_col, row_col=row_col), "chunks")
    order = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text_hash", "row")
    holders = occurrences.groupBy("d0", "d1").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = holders.select("d0", "d1", F.col("first.row").alias("first_row"), F.nullif(F.col("first.id"), F.lit(LAST)).alias("first_doc_id"))
    later = occurrences.drop("text_hash").join(firsts, ["d0", "d1"]).filter((F.col("row") != F.col("first_row")) | F.col("again"))
    start = F.shiftright("place", 24)
    size = F.shiftright("place", 12).bitwiseAND(F.lit(4095))
    spans = later.select("row", "doc_id", "first_doc_id", start.alias("start"), (start + size).alias("end"), F.col("place").bitwiseAND(F.lit(4095)).alias("words"))
    in_text = Window.partitionBy("row").orderBy("start")
    broken = F.coalesce(F.lag("end").over(in_text) != F.col("start"), F.lit(True)).cast("int")
    numbered = spans.withColumn("broken", broken).withColumn("run", F.sum("broken").over(in_text))
    runs = numbered.groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start_byte"), F.max("end").alias("end_byte"), F.sum("words").alias("n_words"),
        F.min("first_doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n_chunks"),
    )
    return runs.filter(F.col("n_words") >= min_words).drop("run")


def without_repeats(docs: DataFrame, *, min_words: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their repeated passages cut out, in the columns of ``docs``; rows without any stay as they are, and a cut
    never parts a character, as ends move inwards to whole ones."""
    rows = written(docs.withColumn("__sf_row", F.monotonically_increasing_id()), "chunk-documents")
    runs = repeated(rows, min_words=min_words, id_col=id_col, text_col=text_col, row_col="__sf_row")
    cut = runs.groupBy(F.col("row").alias("__sf_row")).agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias("__sf_cut"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_without(t, s) for t, s in zip(texts, spans, strict=True)])

    joined = rows.join(cut, "__sf_row", "left")
    text = F.when(F.col("__sf_cut").isNull(), F.col(text_col)).otherwise(without(F.col(text_col), F.col("__sf_cut")))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def _without(text: str | None, spans) -> str | None:
    if text is None or spans is None:
        return text
    data, out, at = text.encode(), [], 0
    for s in spans:
        a, b = s["start_byte"], s["end_byte"]
        while a < b and a < len(data) and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]]).decode()
