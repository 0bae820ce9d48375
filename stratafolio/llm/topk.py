"""Exact top-k search by inner product: distributed histogram selection over integer vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratafolio.llm._shared import shared_dir, written

#: Queries of one block. A block is what a round broadcasts: 8,192 vectors, some 4 MB at 64 components.
BLOCK = 8_192
#: Bins of a histogram round; a round divides every query's open interval by this.
BINS = 1024
#: Candidates that are scored at once against a slice of the queries.
CHUNK, SLICE = 1024, 2048
#: Scores saturate here, far beyond what components of any use can reach.
LIMIT = 1 << 61


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component x as double; null where the vector, or one of its components, is null or not finite.

    Components beyond what a long holds saturate.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


@dataclass
class _Group:
    """Queries of one dimension: their vectors, and where they stand in the block."""

    vectors: np.ndarray
    ids: np.ndarray
    place: np.ndarray
    kind: type


def _grouped(ids: list[int], vectors: list[list[int]], widest: float) -> list[_Group]:
    """By dimension. ``widest`` bounds every candidate's length, so it tells which arithmetic is exact: float32 to 2**24, float64
    to 2**53, and Python's integers beyond."""
    by: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by.setdefault(len(v), []).append(i)
    out = []
    for dim, places in by.items():
        longest = max((math.sqrt(sum(float(x) ** 2 for x in vectors[i])) for i in places), default=0.0)
        bound = max(longest * widest, longest, widest)
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
        m = np.array([vectors[i] for i in places], dtype=kind).reshape(len(places), dim)
        out.append(_Group(m, np.array([ids[i] for i in places], dtype=np.int64), np.array(places, dtype=np.int64), kind))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Pieces of candidates that have one dimension: ids, whether an id is null, dimension, vectors. The first are small, as
    every score passes until a task has seen k of them."""
    size = 64
    for batch in batches:
        column = batch.column("v")
        flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        lengths = np.diff(offsets)
        null = np.asarray(batch.column("vec_id").is_null())
        ids = batch.column("vec_id").fill_null(0).to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths).tolist():
            rows, at = np.flatnonzero(lengths == dim), 0
            while at < len(rows):
                some = rows[at : at + size]
                yield ids[some], null[some], dim, flat[offsets[some][:, None] + np.arange(dim)[None, :]].reshape(len(some), dim)
                at += len(some)
                size = min(CHUNK, 2 * size)


def _pairs(groups: list[_Group], batches: Iterator[pa.RecordBatch], least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every piece of candidates and slice of queries, the pairs that score at least ``least`` of the query: places of the
    queries, scores, candidate ids and their null marks. The caller may raise ``least`` between two pieces."""
    for ids, null, dim, vectors in _chunks(batches):
        for g in groups:
            if g.vectors.shape[1] != dim:
                continue
            candidates = vectors.astype(g.kind).T
            for at in range(0, len(g.place), SLICE):
                places, own = g.place[at : at + SLICE], g.ids[at : at + SLICE]
                s = g.vectors[at : at + SLICE] @ candidates if dim else np.zeros((len(places), len(ids)))
                if g.kind is object:
                    s = np.clip(s, -LIMIT, LIMIT).astype(np.int64)
                q, c = np.nonzero(s >= least[places][:, None])
                other = (own[q] != ids[c]) | null[c]
                q, c = q[other], c[other]
                if len(q):
                    yield places[q], s[q, c].astype(np.int64), ids[c], null[c]


def _histogram(groups: list[_Group], low: np.ndarray, high: np.ndarray, width: np.ndarray, need: np.ndarray):
    """A task that counts, by bin, the scores in each query's open interval [low, high).

    It leaves out the bins below its own ``need``-th best: that many better ones exist, so the place looked for is not there.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(low), BINS), dtype=np.int64)
        least = low.copy()
        for places, scores, _, _ in _pairs(groups, batches, least):
            inside = scores < high[places]
            places, scores = places[inside], scores[inside]
            np.add.at(counts, (places, (scores - low[places]) // width[places]), 1)
            touched = np.unique(places)
            reached = counts[touched, ::-1].cumsum(axis=1) >= need[touched][:, None]
            full = reached.any(axis=1)
            least[touched[full]] = low[touched[full]] + (BINS - 1 - reached[full].argmax(axis=1)) * width[touched[full]]
        place, at = np.nonzero(counts)
        enough = low[place] + at * width[place] >= least[place]
        place, at = place[enough], at[enough]
        for k in range(0, len(place), 100_000):
            some = slice(k, k + 100_000)
            yield pa.RecordBatch.from_pydict({"place": place[some], "bin": at[some], "n": counts[place[some], at[some]], "need": need[place[some]]})

    return task


def _select(groups: list[_Group], query_ids: np.ndarray, kth: np.ndarray, k: int):
    """A task that yields its pairs at or above their query's kth score, of which at most the k best of a query can matter."""

    def best(parts: list[tuple]) -> tuple:
        places, scores, ids, null = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, null, -scores, places))
        places, scores, ids, null = places[order], scores[order], ids[order], null[order]
        start = np.r_[True, places[1:] != places[:-1]]
        rank = np.arange(len(places)) - np.maximum.accumulate(np.where(start, np.arange(len(places)), 0))
        return tuple(x[rank < k] for x in (places, scores, ids, null))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for part in _pairs(groups, batches, kth):
            parts.append(part)
            held += len(part[0])
            if held > 2_000_000:
                parts, held = [best(parts)], 0
        if parts:
            places, scores, ids, null = best(parts)
            yield pa.RecordBatch.from_pydict({"place": places, "query_id": query_ids[places], "vec_id": pa.array(ids, pa.int64(), mask=null), "score": scores})

    return task


def _kth(candidates: DataFrame, groups: list[_Group], bound: np.ndarray, k: int) -> np.ndarray:
    """The kth best score of each query, refined round by round; a bound below all scores for a query with fewer than k.

    A round returns one row per query: the bin that holds the kth score, and how many lie in the bins above it.
    """
    n = len(bound)
    low, high, need = -bound, bound + 1, np.full(n, k, dtype=np.int64)
    width = -(-(high - low) // BINS)
    open_ = np.ones(n, dtype=bool)
    while open_.any():
        still = [_Group(g.vectors[m], g.ids[m], g.place[m], g.kind) for g in groups if (m := open_[g.place]).any()]
        found = candidates.mapInArrow(_histogram(still, low, high, width, need), "place long, bin long, n long, need long")
        bins = found.groupBy("place", "bin").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
        above = bins.withColumn("above", F.sum("n").over(Window.partitionBy("place").orderBy(F.desc("bin"))) - F.col("n")).filter("above < need")
        last = above.groupBy("place").agg(F.min_by(F.struct("bin", "above", "n"), "bin").alias("last")).select("place", "last.*")
        rows = {r["place"]: (r["bin"], r["above"], r["n"]) for r in last.toArrow().to_pylist()}
        for p in np.flatnonzero(open_).tolist():
            at, over, count = rows.get(p, (0, 0, 0))
            if over + count < need[p]:
                open_[p] = False
                continue
            low[p], need[p] = low[p] + at * width[p], need[p] - over
            high[p] = min(high[p], low[p] + width[p])
            open_[p] = width[p] > 1
            width[p] = -(-(high[p] - low[p]) // BINS)
    return low


def topk(vectors: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """Each query's k best candidates: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    ``vectors`` and ``queries`` have an id and an array of numbers. The score is the integer inner product of floor(scale * x).
    Vectors that are null or hold a null or non-finite component take no part; a candidate with the query's own id is left
    out; only vectors of the query's dimension are compared, and two empty ones score 0. Repeated candidate rows each take a
    rank, as repeated query rows each get an answer. A query without any candidate has no rows; empty tables give none.

    Queries are taken in blocks of ``BLOCK``, whatever their number, and a block is all that is sent out. The candidates are
    scored once per histogram round and once for the final filter; tasks send counts and at most k pairs per query.
    """
    spark = vectors.sparkSession
    ready = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v")).filter(F.col("v").isNotNull())
    candidates = written(ready(vectors), "topk-candidates")
    asked = written(ready(queries).filter(F.col("vec_id").isNotNull()), "topk-queries")
    n = asked.count()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    widest = candidates.agg(F.max(norm)).first()[0] or 0.0
    folder = shared_dir(spark, "topk-blocks")
    asked.repartition(max(1, -(-n // BLOCK))).write.option("maxRecordsPerFile", BLOCK).parquet(folder)
    answers, schema = shared_dir(spark, "topk-answers"), "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(answers)
    for file in sorted(spark.read.schema(asked.schema).parquet(folder).inputFiles()):
        rows = spark.read.schema(asked.schema).parquet(file).toArrow()
        if not rows.num_rows:
            continue
        ids, own = rows.column("vec_id").to_pylist(), rows.column("v").to_pylist()
        groups = _grouped(ids, own, widest)
        lengths = np.array([math.sqrt(sum(float(x) ** 2 for x in v)) for v in own])
        bound = np.array([min(LIMIT, int(x * widest) + 2) for x in lengths.tolist()], dtype=np.int64)
        kth = _kth(candidates, groups, bound, k)
        found = candidates.mapInArrow(_select(groups, np.array(ids, dtype=np.int64), kth, k), "place long, query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
        best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(answers)
    return spark.read.schema(schema).parquet(answers)
