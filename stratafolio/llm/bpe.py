"""Byte-level BPE by corpus-level merge replay, and decoding.

The distinct pieces of a block of documents lie in one array of tokens. An inverted index leads from a pair's merged token to
all its places; merges are applied in rank order, each at all its places, and touch only the places' neighbours.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafolio.llm.pieces import Encoder, blocks


class Merges:
    """The ranks of a vocabulary file of lines "base64 rank". A pair's rank is that of its bytes together."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}  # (first << 20 | second) -> merged, as met
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.at = np.r_[0, np.cumsum([len(t) for t in self.tokens])]

    def merged(self, a: int, b: int) -> int:
        """The token that a pair merges to; -1 for none."""
        key = a << 20 | b
        if (r := self.pairs.get(key)) is None:
            r = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return r

    def alone(self, piece: bytes) -> list[int]:
        """One piece by itself: the lowest-ranked pair, the leftmost of equal ones, is merged again and again."""
        ids = [self.single[b] for b in piece]
        while len(ids) > 1:
            r, i = min(((r, i) for i in range(len(ids) - 1) if (r := self.merged(ids[i], ids[i + 1])) >= 0), default=(-1, 0))
            if r < 0:
                break
            ids[i : i + 2] = [r]
        return ids

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of distinct pieces. One that is a token as a whole is that token."""
        out: list[list[int]] = [[r] if (r := self.ranks.get(p)) is not None else [] for p in pieces]
        todo = [i for i, ids in enumerate(out) if not ids]
        if not todo:
            return out
        ends = np.cumsum([len(pieces[i]) for i in todo])
        starts = (ends - [len(pieces[i]) for i in todo]).tolist()
        token = [self.single[b] for i in todo for b in pieces[i]]
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for e in ends.tolist():
            after[e - 1] = -1
        for s in starts:
            before[s] = -1
        merged = self.merged
        pair = [merged(token[i], token[i + 1]) if after[i] > 0 else -1 for i in range(n)]  # of the pair that begins at a place
        index: dict[int, list[int]] = {}
        for i, r in enumerate(pair):
            if r >= 0:
                index.setdefault(r, []).append(i)
        ranks, again = list(index), set()
        heapify(ranks)
        while ranks:
            rank = heappop(ranks)
            places = index.pop(rank)
            places.sort()
            for i in places:
                if pair[i] != rank:
                    continue  # a neighbour's merge took it
                j = after[i]
                k = after[j]
                token[i], after[i], pair[j] = rank, k, -1
                if k >= 0:
                    before[k] = i
                    r = pair[i] = merged(rank, token[k])
                    if r >= 0:
                        if r < rank:
                            again.add(i)
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heappush(ranks, r)
                else:
                    pair[i] = -1
                h = before[i]
                if h >= 0:
                    r = pair[h] = merged(token[h], rank)
                    if r >= 0:
                        if r < rank:
                            again.add(i)
                        if r in index:
                            index[r].append(h)
                        else:
                            index[r] = [h]
                            heappush(ranks, r)
        for w, s in zip(todo, starts, strict=True):
            ids, i = out[w], s
            while i >= 0:
                ids.append(token[i])
                i = after[i]
        # a merge that made a pair of lower rank than its own: inside that piece the next step is not the corpus's next rank
        for i in again:
            w = todo[bisect_right(starts, i) - 1]
            out[w] = self.alone(pieces[w])
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and the end of each id's bytes."""
        length = self.at[ids + 1] - self.at[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.at[ids] - (ends - length), length) + np.arange(total)], ends


@cache
def merges(path: str) -> Merges:
    return Merges(path)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(merges(path).replay)


def encoded(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (unsigned 32-bit integers, little-endian, as bytes), n_tokens and decoded (bytes decoded from the ids).

    Whole texts are encoded as ordinary text, without special tokens. A null text is empty: no ids, no bytes; an empty table
    gives no rows; a null id stays null. There is no shuffle. Memory holds a block of documents and a bounded store of pieces;
    ``vocabulary`` is a path that every executor has.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, enc = merges(vocabulary), encoder(vocabulary)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            done = 0
            for block in blocks(x.as_py() or b"" for x in texts):
                ids, at = enc.block(block)
                raw, ends = table.decode(ids)
                ends = np.r_[0, ends][at]
                at_list, ends_list = at.tolist(), ends.tolist()
                packed, decoded = ids.astype("<u4").tobytes(), raw.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(done, len(block)),
                        pa.array([packed[4 * a : 4 * b] for a, b in zip(at_list, at_list[1:], strict=False)], pa.binary()),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([decoded[a:b] for a, b in zip(ends_list, ends_list[1:], strict=False)], pa.binary()),
                    ],
                    ["doc_id", "ids", "n_tokens", "decoded"],
                )
                done += len(block)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(task, "doc_id long, ids binary, n_tokens long, decoded binary")


def digests(docs: DataFrame, vocabulary: str, **columns: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded bytes; the digests are taken beside the JVM's other work."""
    out = encoded(docs, vocabulary, **columns)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


