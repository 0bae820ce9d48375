"""Quality rules: statistics of single texts, and lines that too many documents of a host share."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafolio.llm._shared import written

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Above this many rows a list of common lines, or of rejected documents, is joined by a shuffle; below it is some 40 MB.
BROADCAST_ROWS = 1_000_000

#: Texts of more words have their windows counted by arrays of numbers, which take some 100 bytes a word instead of 300.
LONG = 1 << 15

FEATURES = (
    "row long, doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lines array<struct<line:long,words:long>>"
)
_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))
_SCHEMA = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("host", pa.string()), ("text_hash", pa.int64())]
    + [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("lines", _LINES)]
)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in some 3-word window which the text has at least twice."""
    if len(words) > LONG:
        return _covered(_repeated_windows(words), len(words))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    return _covered(np.fromiter((counts[w] > 1 for w in windows), dtype=bool, count=len(windows)), len(words))


def _repeated_windows(words: list[bytes]) -> np.ndarray:
    """Whether each 3-word window occurs twice or more; windows are numbered from numbered words, two at a time."""
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    two = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
    which, counts = np.unique(two[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)[1:]
    return counts[which] > 1


def _covered(starts: np.ndarray, n: int) -> int:
    """How many of n words lie in the windows marked in ``starts``."""
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : k + len(starts)] |= starts
    return int(covered.sum())


def text_features(data: bytes) -> dict:
    """The statistics of one UTF-8 text, and its normalised lines: hash and words, once per distinct line.

    Words are runs of bytes other than ASCII white space, which is what ``bytes.split`` cuts at. A line is normalised by
    lower-casing A-Z and joining its words with single spaces, and known by 60 bits of its MD5; lines without a word are left out.
    """
    words, seen, dup, lines = [], set(), 0, {}
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            continue
        words += own
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        key = int.from_bytes(hashlib.md5(b" ".join(own).lower()).digest()[:8], "big") >> 4
        lines[key] = lines.get(key, 0) + len(own)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, map(bytes.decode, words))) if not data.isascii() else sum(map(len, words)),
        "n_symbols": sum(data.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))),
        "n_dup_lines": dup,
        "n_repeat_words": repeat_words(words),
        "lines": [{"line": k, "words": n} for k, n in lines.items()],
    }


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for at in range(0, len(batch), 512):
            some = batch.slice(at, 512)
            out = [text_features(x.as_py() or b"") for x in texts.slice(at, 512)]
            fixed = {"row": range(row, row + len(out)), **{k: some.column(k).to_pylist() for k in ("doc_id", "host", "text_hash")}}
            columns = [pa.array(fixed[f.name] if f.name in fixed else [x[f.name] for x in out], f.type) for f in _SCHEMA]
            row += len(out)
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row of statistics and line hashes per document, written to the shared folder; nulls in any column are kept, and a
    null text counts as empty."""
    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), _text_hash(text_col).alias("text_hash"),
        F.col(text_col).cast("string").alias("text"),
    )
    return written(chosen.mapInArrow(_features, FEATURES), "quality-features")


def common_lines(feats: DataFrame, *, min_docs: int = 10, share: float = 0.01) -> DataFrame:
    """Lines (host, line) that more than ``min_docs`` and more than ``share`` of a host's distinct documents have.

    Documents are distinct if their texts are (64 bits of hash), so copies of one text count once, and texts that differ in any
    way count each. A null host is a host of its own; a null text counts as empty.

    The distinct counts are aggregated by (host, line, text) first, on the map side and after a shuffle by all three, so a line
    or a host that a third of the documents have is spread over all tasks.
    """
    occurrences = feats.select("host", "text_hash", F.explode("lines.line").alias("line"))
    counts = occurrences.groupBy("host", "line").agg(F.countDistinct("text_hash").alias("docs"))
    hosts = feats.groupBy("host").agg(F.countDistinct("text_hash").alias("host_docs"))
    named = hosts.select(F.col("host").alias("host_"), "host_docs")
    over = counts.filter(F.col("docs") > min_docs).join(named, F.col("host").eqNullSafe(F.col("host_")))
    return written(over.filter(F.col("docs") > share * F.col("host_docs")).select("host", "line"), "quality-common")


def judged(feats: DataFrame, *, min_docs: int = 10, share: float = 0.01, min_words: int = 50, max_repeat: int = 50, max_removed: int = 50) -> DataFrame:
    """The features (without lines) with removed_words, base_failed and kept.

    ``base_failed``: fewer than ``min_words`` words, or over ``max_repeat`` % of them in repeated windows. ``kept``: not
    base_failed, and not depleted: the common lines hold at most ``max_removed`` % of the words.
    """
    common = common_lines(feats, min_docs=min_docs, share=share)
    named = common.select(F.col("host").alias("host_"), F.col("line").alias("line_"))
    small = common.count() <= BROADCAST_ROWS
    occurrences = feats.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.line", "l.words")
    same = (F.col("line") == F.col("line_")) & F.col("host").eqNullSafe(F.col("host_"))
    hits = occurrences.join(F.broadcast(named) if small else named.hint("merge"), same)
    removed = hits.groupBy("row").agg(F.sum("words").alias("removed_words"))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    out = feats.drop("lines").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    depleted = 100 * F.col("removed_words") > max_removed * F.col("n_words")
    return out.withColumn("base_failed", base).withColumn("kept", ~base & ~depleted)


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """Statistics and verdict per document; limits as in :func:`judged`.

    Repeated rows each have one; no documents, no rows; a null or empty text has 0 words and fails; nothing is ranked, so there are
    no ties. Only the three columns named are read, so others may have any names.
    """
    return judged(features(docs, id_col=id_col, text_col=text_col, host_col=host_col), **limits)


def kept_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents that pass, with all their columns.

    A verdict depends on the host and the text alone, so the rejected (id, host, text hash) are taken out by an anti join,
    broadcast while counted to be few. Texts are shuffled only beyond that.
    """
    verdicts = written(quality(docs, id_col=id_col, text_col=text_col, host_col=host_col, **limits).filter("NOT kept").select("doc_id", "host", "text_hash").distinct(), "quality-rejected")
    small = verdicts.count() <= BROADCAST_ROWS
    bad = verdicts.select(F.col("doc_id").alias("__sf_id"), F.col("host").alias("__sf_host"), F.col("text_hash").alias("__sf_hash"))
    same = (
        (_text_hash(text_col) == F.col("__sf_hash"))
        & F.col(id_col).cast("long").eqNullSafe(F.col("__sf_id"))
        & F.col(host_col).cast("string").eqNullSafe(F.col("__sf_host"))
    )
    return docs.join(F.broadcast(bad) if small else bad.hint("merge"), same, "left_anti")
