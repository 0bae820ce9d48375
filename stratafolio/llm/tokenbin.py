"""Token ids in flat binary files.

A data set is a folder of parts. Part P has ``.bin`` (ids, unsigned 16 or 32-bit, little-endian, document after document),
``.off`` (64-bit offsets into the part, one per document and the end) and ``.doc`` (64-bit document ids). The manifest (Parquet)
has a part's counts and its base: the ids of all parts before it, a prefix sum. Every file can be memory-mapped.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafolio.llm._shared import open_fs, shared_dir, spread
from stratafolio.llm.pieces import Encoder, blocks

#: Pieces that go to the tokenizers library as one string.
TOGETHER = 64
#: Reading tasks at most; beyond that a task reads several parts.
MOST_TASKS = 100_000
PARTS = "part long, stem string, docs long, null_docs long, ids long, width int"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


@cache
def tokenizer(path: str):
    """The library's tokenizer as it is, but that it keeps to the task's thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def added(path: str) -> list[bytes]:
    """The strings that the library takes out of a text before it cuts it into pieces, such as those of special tokens."""
    return [x.content.encode() for x in tokenizer(path).get_added_tokens_decoder().values()]


def encode_pieces(path: str, pieces: list[bytes]) -> list[list[int]]:
    """The library's ids of distinct pieces.

    Pieces that begin with a blank and go on solid are cut before their blanks, so many go as one string, and the library's
    word numbers tell them apart; a string whose words don't come out as its pieces is encoded piece by piece.
    """
    t = tokenizer(path)
    texts = [p.decode("utf-8") for p in pieces]
    out: list[list[int]] = [[] for _ in pieces]
    joined = [i for i, x in enumerate(texts) if len(x) > 1 and x[0] == " " and not x[1:].isspace()]
    alone = set(range(len(texts))) - set(joined)
    groups = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)]
    for group, e in zip(groups, t.encode_batch(["".join(texts[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
        words = e.word_ids
        if not words or words[-1] != len(group) - 1:
            alone.update(group)
            continue
        for w, x in zip(words, e.ids, strict=True):
            out[group[w]].append(x)
    rest = sorted(alone)
    for i, e in zip(rest, t.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
        out[i] = e.ids
    return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(lambda pieces: encode_pieces(path, pieces))


def encoded(path: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and where each text's begin (and the end). A text that holds an added token's string is encoded whole by
    the library, without special tokens of the library's own making; the others go by their pieces."""
    whole = [i for i, x in enumerate(texts) if any(a in x for a in added(path))]
    if not whole:
        return encoder(path).block(texts)
    ids, at = encoder(path).block([b"" if any(a in x for a in added(path)) else x for x in texts])
    parts = np.split(ids, at[1:-1])
    for i in whole:
        parts[i] = np.array(tokenizer(path).encode(texts[i].decode(), add_special_tokens=False).ids, np.uint32)
    return np.concatenate(parts).astype(np.uint32), np.r_[0, np.cumsum([len(x) for x in parts])]


def ended(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets with ``end_id`` after every document."""
    n = len(at) - 1
    out = np.full(len(ids) + n, end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
    return out, at + np.arange(n + 1)


def write_ids(docs: DataFrame, path: str, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encodes whole texts, writes them in ascending order of the id and returns the manifest with each part's base.

    Ids are those of the library with ``add_special_tokens=False``: a special token's string in a text is that token. Null ids come
    first; rows that share an id are ordered by their text's hash, and equal ones stand side by side. A null or empty text is its
    end id alone. An empty table writes no part. Only the columns named are read.

    Rows are dealt by range of the id, sampled by Spark, and encoded in the task that writes them. File names hold the task
    attempt, and only attempts that succeeded reach the manifest. The manifest, a row per part, is all that is summed in order.
    """
    folder = folder or shared_dir(docs.sparkSession, "token-ids")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        wide = tokenizer(path).get_vocab_size(with_added_tokens=True) > 1 << 16
        kind, total, n, nulls = ("<u4" if wide else "<u2"), 0, 0, 0
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        with ExitStack() as stack:
            files = None
            for batch in batches:
                done, texts = 0, batch.column("text").cast(pa.large_binary())
                for block in blocks(x.as_py() or b"" for x in texts):
                    if files is None:
                        store, root = open_fs(folder)
                        store.create_dir(root, recursive=True)
                        files = [stack.enter_context(store.open_output_stream(f"{root}/{name}.{x}", compression=None)) for x in ("bin", "off", "doc")]
                    ids, at = ended(*encoded(path, block), end_id)
                    doc = batch.column("doc_id").slice(done, len(block))
                    files[0].write(ids.astype(kind).tobytes())
                    files[1].write((at[:-1] + total).astype("<i8").tobytes())
                    files[2].write(doc.fill_null(0).to_numpy().astype("<i8").tobytes())
                    total, n, nulls, done = total + len(ids), n + len(block), nulls + doc.null_count, done + len(block)
            if files is not None:
                files[1].write(np.array([total], "<i8").tobytes())
        if n:
            yield pa.RecordBatch.from_pydict({
                "part": [context.partitionId()], "stem": [f"{folder}/{name}"], "docs": [n], "null_docs": [nulls], "ids": [total],
                "width": pa.array([4 if wide else 2], pa.int32()),
            })

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    dealt = chosen.withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "text").mapInArrow(task, PARTS).write.parquet(f"{folder}/manifest")
    return manifest(docs.sparkSession, folder)


def manifest(spark, folder: str) -> DataFrame:
    """The parts of a data set in order, with ``base``, the ids before each."""
    parts = spark.read.schema(PARTS).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def mapped(uri: str, kind: str) -> np.ndarray:
    """A file of numbers, memory-mapped where the store is a local or mounted folder, else read through the store."""
    store, path = open_fs(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def read_ids(parts: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers), and the ids themselves on demand."""
    schema = ROWS if with_ids else ROWS.rpartition(",")[0]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                ids, off, doc = mapped(f"{p['stem']}.bin", f"<u{p['width']}"), mapped(f"{p['stem']}.off", "<i8"), mapped(f"{p['stem']}.doc", "<i8")
                if len(off) != p["docs"] + 1 or len(doc) != p["docs"] or int(off[-1]) != p["ids"] or len(ids) != p["ids"]:
                    raise ValueError(f"{p['stem']}: the files don't have what the manifest states")
                for at in range(0, p["docs"], 1024):
                    some = off[at : at + 1025].astype(np.int64)
                    flat = ids[some[0] : some[-1]].astype("<u4").tobytes()
                    ends = ((some - some[0]) * 4).tolist()
                    raw = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                    known = np.arange(at, at + len(raw)) < p["null_docs"]  # null ids stand first
                    columns = [
                        pa.array(doc[at : at + len(raw)], pa.int64(), mask=known), pa.array(some[:-1] + p["base"], pa.int64()),
                        pa.array(np.diff(some), pa.int64()), pa.array(map(zlib.crc32, raw), pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return spread(parts.select("stem", "docs", "null_docs", "ids", "width", "base"), MOST_TASKS).mapInArrow(task, schema)
