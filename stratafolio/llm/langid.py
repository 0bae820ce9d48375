"""Language identification: the nearest of several clustered centroids per language, over normalised TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafolio.llm._shared import written

#: N-grams of 1, 2 and 3 characters are hashed to so many features.
FEATURES = 4096
#: Centroids per language, and rounds of clustering.
CLUSTERS, ROUNDS = 4, 12
#: The classifier is fitted on about so many documents of each language at most, chosen by the hash of the id.
SAMPLE = 1000
#: Characters that are counted at once, and documents that are compared at once.
PIECE, TOGETHER = 1 << 20, 256
UNKNOWN = "und"


def counts(text: str) -> tuple[np.ndarray, bool]:
    """Hashed n-gram counts of a whole text, and whether it has a letter.

    The text is lower-cased, and every run of characters other than letters becomes one blank, so digits, symbols and layout
    don't count. A piece shares two characters with the one before it, so that no n-gram is lost between pieces.
    """
    total, letters, tail, last = np.zeros(FEATURES), False, np.full(2, 32, np.uint32), False
    for at in range(0, len(text), PIECE):
        code = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)
        solid = _letters()[np.minimum(code, 0x10FFFF)]
        letters |= bool(solid.any())
        code = np.where(solid, code, 32).astype(np.uint32)
        keep, last = solid | np.r_[last, solid[:-1]], bool(solid[-1])
        code = np.concatenate([tail, code[keep]])
        one, two, three = code[2:], code[1:-1], code[:-2]
        a = one * np.uint32(0x9E3779B1)
        b = (a ^ (two + np.uint32(1))) * np.uint32(0x85EBCA77)
        c = (b ^ (three + np.uint32(2))) * np.uint32(0xC2B2AE3D)
        for h in (a, b, c):
            total += np.bincount((h >> np.uint32(20)).astype(np.int64), minlength=FEATURES)
        tail = code[-2:]
    return total, letters


_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter, as str.isalpha tells."""
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


def weighed(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows (1 + log of the count, by idf) of length 1; a row of nothing stays 0."""
    out = np.where(rows > 0, 1 + np.log(np.maximum(rows, 1)), 0) * idf.astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def clustered(rows: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids of length 1, and for each the similarity that 99 % of its members reach. The first centre is
    the row nearest to the mean and each next one the row least like those before, so the outcome is always the same."""
    centres = [rows[int((rows @ rows.mean(axis=0)).argmax())]]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[int((rows @ np.array(centres).T).max(axis=1).argmin())])
    c = np.array(centres)
    for _ in range(rounds):
        own = (rows @ c.T).argmax(axis=1)
        new = np.array([rows[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    similar = rows @ c.T
    own = similar.argmax(axis=1)
    edge = np.array([np.quantile(similar[own == i, i], 0.01) if (own == i).any() else 0.0 for i in range(len(c))])
    return c.astype(np.float32), edge


@dataclass
class Model:
    """idf of the features; centroids, their languages, and the similarity below which a text is too far from them."""

    idf: np.ndarray
    centres: np.ndarray
    langs: list[str]
    edges: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, mod 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key: Column | None = None) -> Model:
    """The model of labelled documents (rows with a null text or language teach nothing).

    Document frequencies are counted over all of them; they come to the driver as one number per feature. The centroids are
    fitted per language on a sample of about ``SAMPLE`` documents, chosen by the hash of ``key`` (default: the text) so that
    the choice is the same in every run; a group is at most that large whatever the language's share of the rows.
    """
    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(key if key is not None else F.col(text_col)).alias("h"))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for x in batch.column("text"):
                df += counts(x.as_py())[0] > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"feature": np.r_[np.arange(FEATURES), -1].astype(np.int32), "n": np.r_[df, n]})

    rows = known.select("text").mapInArrow(frequency, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = {r["feature"]: r["n"] for r in rows}
    total = df.pop(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + df.get(i, 0))) + 0.1 for i in range(FEATURES)])
    per = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langid-langs")
    chosen = known.join(per, "lang").filter(F.pmod("h", F.lit(1 << 30)).cast("double") * F.col("n") < float(SAMPLE << 30)).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                some = batch.slice(at, TOGETHER)
                rows = weighed(np.array([counts(x.as_py())[0] for x in some.column("text")], dtype=np.float32), idf)
                yield pa.RecordBatch.from_arrays([some.column("lang"), pa.array(list(rows), pa.list_(pa.float32()))], ["lang", "vector"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.array(sorted(group["vector"], key=lambda v: v.tobytes()), dtype=np.float32)
        centres, edges = clustered(rows)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "edge": edges, "centre": list(centres)})

    chosen = chosen.mapInArrow(vectors, "lang string, vector array<float>")  # a text's size no longer matters from here on
    found = written(chosen.groupBy("lang").applyInPandas(fit, "lang string, edge double, centre array<float>"), "langid-centres")
    best = sorted(found.collect(), key=lambda r: (r["lang"], r["centre"]))
    centres = np.array([r["centre"] for r in best], dtype=np.float32).reshape(len(best), FEATURES)
    return Model(idf, centres, [r["lang"] for r in best], np.array([r["edge"] for r in best]))


def predicted(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected for every document, from its whole text alone.

    ``score`` is the cosine to the nearest centroid, cut to 0..1; ``rejected`` is true where it lies below what that centroid's
    own members reach, so the text is likely in none of the languages. A text that is null or has no letter is ``und`` with
    score 0 and rejected, as is every text if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # clusters x languages x features numbers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                some = batch.slice(at, TOGETHER)
                found = [counts(x.as_py() or "") for x in some.column("text")]
                usable = np.array([has for _, has in found]) & bool(m.langs)
                lang, score, far = [UNKNOWN] * len(found), np.zeros(len(found)), np.ones(len(found), bool)
                if m.langs:
                    similar = weighed(np.array([c for c, _ in found], dtype=np.float32), m.idf) @ m.centres.T
                    near = similar.argmax(axis=1)
                    best = similar[np.arange(len(near)), near].astype(np.float64)
                    lang = [m.langs[i] if u else UNKNOWN for i, u in zip(near, usable, strict=True)]
                    score, far = np.where(usable, np.clip(best, 0, 1), 0.0), ~usable | (best < m.edges[near])
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(task, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the documents that aren't held out and predicts all: doc_id, held_out, lang_pred, score, rejected.

    Rows with a null id, text or language teach nothing; a null or letterless text is ``und``; whole texts count, however long;
    of equally near centroids the first in the order of languages wins; repeated rows each have a row; an empty table gives none.
    Only the columns named are read, so others may have any names.
    """
    teach = docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    model = fitted(teach, text_col=text_col, lang_col=lang_col, key=F.col(id_col))
    return predicted(docs, model, id_col=id_col, text_col=text_col).withColumn("held_out", held_out(F.col("doc_id")))
