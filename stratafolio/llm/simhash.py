"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at few differing bits by meeting in the middle.

Two fingerprints at distance r <= 3 are found without comparing all pairs. The 64 positions are dealt into three blocks. If
they differ at all, some block holds a difference; with that block left out at most two differences remain, so their variants
of radius one (half of two) meet. Every fingerprint therefore emits, for each block left out, the remainder's variants of
radius one: 130 rows in place of the 1,000 to 2,000 that variants of all 64 bits would take, and rows meet by chance with the
probability of 42 equal bits. Rows are shuffled by variant, and what meets is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafolio.llm._shared import written

RADIUS = 3
#: Above this many rows to drop, they are joined by a shuffle; below it they are some 20 MB.
BROADCAST_ROWS = 1_000_000
#: The blocks of bit positions that variants leave out in turn.
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: Shingles that are unpacked to bits at once.
PIECE = 1 << 16


# --------------------------------------------------------------------------------------------------------- fingerprints


def shingles(data: bytes, words: int) -> Iterator[list[bytes]]:
    """Lower-cased (A-Z) word shingles of a UTF-8 text, repeats included, ``PIECE`` at a time; all words where there are fewer; none
    without a word."""
    w = data.lower().split()
    if len(w) <= words:
        yield [b" ".join(w)] if w else []
        return
    for at in range(0, len(w) - words + 1, PIECE):
        some = w[at : at + PIECE + words - 1]
        yield list(map(b" ".join, zip(*(some[i:] for i in range(words)), strict=False)))


def fingerprint(data: bytes, words: int = 3, seed: int = 42) -> int:
    """The fingerprint as a signed long: a bit is 1 if it is set in over half of the shingles' XXH64."""
    ones, n = np.zeros(64), 0
    for some in shingles(data, words):
        digests = np.frombuffer(b"".join([xxhash.xxh64_digest(s, seed) for s in some]), np.uint8)
        bits = np.unpackbits(digests).reshape(-1, 64)
        ones += np.ones(len(bits), np.float32) @ bits.astype(np.float32)
        n += len(some)
    return int(np.packbits(ones * 2 > n).view(">i8")[0]) if n else 0


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (signed long) of every document; a null, empty or blank text has fingerprint 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for at in range(0, len(batch), 1024):
                fps = [fingerprint(x.as_py() or b"", words, seed) for x in texts.slice(at, 1024)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 1024), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(task, "doc_id long, fp long")


# ---------------------------------------------------------------------------------------------------------------- links


def variants(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys (uint64) and the places in ``fps`` that emit them: per block left out, the remainder's neighbours, and the remainder
    itself if its parity is odd. Neighbours meet neighbours at distance two; at one, the odd remainder is a neighbour of the
    even one; equal ones share all neighbours."""
    places = np.arange(len(fps))
    for b, (low, high) in enumerate(BLOCKS):
        mask = np.uint64((1 << high) - (1 << low))
        rest = fps & ~mask
        tag = np.uint64((b + 1) << low)  # in the bits left out, so that blocks don't mix
        flips = np.array([1 << i for i in range(64) if not low <= i < high], dtype=np.uint64)
        yield ((rest[:, None] ^ flips[None, :]) | tag).ravel(), np.repeat(places, len(flips))
        odd = np.bitwise_count(rest) % 2 == 1
        yield rest[odd] | tag, places[odd]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the fingerprints in all columns but the first, which names the node."""
    for batch in batches:
        node = batch.column(0).to_numpy()
        for k in range(1, batch.num_columns):
            fps = batch.column(k).to_numpy().view(np.uint64)
            salt = np.uint64((k - 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            for at in range(0, len(fps), 2048):
                for keys, places in variants(fps[at : at + 2048]):
                    yield pa.RecordBatch.from_arrays([pa.array((keys ^ salt).view(np.int64)), pa.array(node[at + places])], ["key", "node"])


def _forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected among the distinct members: each member found is scanned against those not yet
    reached, so a dense ball of any size costs few scans and gives one link a member."""
    out, left = [], members
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= RADIUS
            found = left[near]
            out += [(x, y) for y in found]
            frontier += list(found)
            left = left[~near]
    return out


def _meet(link: Callable[[np.ndarray], list[tuple[int, int]]], radius: int):
    """A task that links the nodes of each key's run, in a partition sorted by key: two nodes if they differ in at most ``radius``
    bits, more by ``link``."""
    return lambda batches: _met(batches, link, radius)


def _met(batches: Iterator[pa.RecordBatch], link: Callable[[np.ndarray], list[tuple[int, int]]], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within each key's run. A run that the batch's end cuts is carried on."""
    held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def runs(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        size = np.diff(np.r_[start, len(keys)])
        two = start[size == 2]
        a, b = fps[two], fps[two + 1]
        near = np.bitwise_count(a ^ b) <= radius
        links = [np.stack([a[near], b[near]], axis=1)]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if found := link(np.unique(fps[s : s + n])):
                links.append(np.array(found, dtype=np.uint64))
        pairs = np.concatenate(links).view(np.int64)
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"]) if len(pairs) else None

    for batch in batches:
        keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
        fps = np.concatenate([held, batch.column("node").to_numpy().view(np.uint64)])
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        held_keys, held = keys[cut:], fps[cut:]
        if out := runs(keys[:cut], fps[:cut]):
            yield out
    if out := runs(held_keys, held):
        yield out


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) that connect all those at most ``RADIUS`` bits apart.

    A key's fingerprints differ only in the block left out and two more bits, so what meets at a key is a family of near
    copies and never grows with the table as such; equal fingerprints were merged before.
    """
    return _links(distinct.select(F.col("fp").alias("node"), "fp"), _forest, RADIUS)


def _links(nodes: DataFrame, link: Callable[[np.ndarray], list[tuple[int, int]]], radius: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes whose variants meet; ``nodes`` has the node first and its fingerprints after it."""
    met = nodes.mapInArrow(_emit, "key long, node long").repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(_meet(link, radius), "a long, b long").distinct()


# ----------------------------------------------------------------------------------------------------------- components


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the component's least node.

    Alternating large-star and small-star rounds over tables in the shared folder, until a round changes nothing: the number of
    rounds grows with the logarithm of the component's size. Minima are partially aggregated; the joins that follow are ones
    whose hot keys AQE splits. Nothing but a count and a checksum comes to the driver.
    """
    edges = written(pairs.select("a", "b").filter("a <> b").distinct(), "cc-links")
    state = _checksum(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = written(small.filter("a <> b").distinct(), "cc-round")
        if (now := _checksum(edges)) == state:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def linked(fps: DataFrame) -> DataFrame:
    """Adds component_id, the smallest doc_id that a chain of links reaches, to rows (doc_id, fp).

    Copies share a fingerprint and are merged before anything is emitted. A null doc_id has no say in the smallest, which is
    null only where all ids are null; rows that repeat stay.
    """
    own = written(fps, "simhash-fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    named = roots.join(distinct, "fp")
    least = named.groupBy("root").agg(F.min("first_id").alias("least_id"))
    reached = named.select("fp", "root").join(least, "root").select("fp", "least_id")
    # written, so that the last join has two plain shuffles below it and AQE can split a fingerprint with very many rows
    table = written(distinct.join(reached, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")), "simhash-components")
    return own.join(table, "fp").select("doc_id", "fp", "component_id")


def simhash(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document; no documents, no rows."""
    out = linked(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ------------------------------------------------------------------------------------------------ near copies by similarity


def _signature(data: bytes) -> tuple[int, int, int]:
    """A text's key (of its lower-cased words in order) and two independent fingerprints of its distinct words.

    An edited word changes one of them but five of the shingles, so near copies by shingles are few bits apart here.
    """
    words = data.lower().split()
    key = xxhash.xxh3_64_intdigest(b" ".join(words), 42)
    distinct = list(set(words))
    ones = np.zeros(128)
    for at in range(0, len(distinct), PIECE):
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in distinct[at : at + PIECE]]), np.uint8)
        bits = np.unpackbits(digests).reshape(-1, 128)
        ones += np.ones(len(bits), np.float32) @ bits.astype(np.float32)
    two = np.packbits(ones * 2 > len(distinct)).view(">i8")
    return key - (1 << 64) if key >> 63 else key, int(two[0]), int(two[1])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for at in range(0, len(batch), 1024):
            rows = [_signature(x.as_py() or b"") for x in texts.slice(at, 1024)]
            own = [batch.column(c).slice(at, 1024) for c in ("row", "doc_id")]
            yield pa.RecordBatch.from_arrays(own + [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["row", "doc_id", "key", "f0", "f1"])


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct nodes (sorted) of each key's run, where there are two or more, in a partition sorted by key; ``family`` is a
    hash of them. Texts that meet at one key mostly meet at many, so equal families are dropped at once."""
    held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def runs(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        size = np.diff(np.r_[start, len(keys)])
        found = {}
        for s, n in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            if len(own := np.unique(nodes[s : s + n])) > 1:
                found[xxhash.xxh3_64_intdigest(own.tobytes())] = own
        names = pa.array(np.array(list(found), np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([names, pa.array(list(found.values()), pa.list_(pa.int64()))], ["family", "nodes"])

    for batch in batches:
        keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
        nodes = np.concatenate([held, batch.column("node").to_numpy()])
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        held_keys, held = keys[cut:], nodes[cut:]
        yield runs(keys[:cut], nodes[:cut])
    yield runs(held_keys, held)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a family's nodes with the least and with the next one: at most two a node. What they leave unlinked is for
    :func:`_across`."""
    for batch in batches:
        pairs = [np.zeros((0, 2), np.int64)]
        for own in batch.column("nodes"):
            x = own.values.to_numpy()
            pairs += [np.stack([np.full(len(x) - 1, x[0]), x[1:]], axis=1), np.stack([x[1:-1], x[2:]], axis=1)]
        yield _pairs(np.unique(np.concatenate(pairs), axis=0))


def _pairs(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _sharing(members: DataFrame, hashes: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members (key, root) of different roots that may reach ``similarity``.

    Sets of n and m shingles that alike share at least o = similarity / (1 + similarity) * (n + m). With all shingles in one order,
    the rarest first, their first common one stands no later than place n - o + 1 in the one and m - o + 1 in the other, so only
    the first n - similarity * n + 1 of a set are joined, and what meets further back makes no pair. The words that an edit
    brought in are rare and stand first: texts edited beyond the similarity meet too late, and so do texts of like words.
    """
    rows = written(members.join(hashes, "key").select("key", "root", F.size("hashes").alias("n"), F.explode("hashes").alias("h")), "near-rest")
    common = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    place = F.row_number().over(Window.partitionBy("key").orderBy("df", "h"))
    placed = rows.join(common, "h", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("left", F.col("n") - place + 1)
    first = written(placed.filter((F.col("left") >= F.ceil(F.col("n") * similarity - 1e-9)) & (F.col("df") > 1)).select("h", "key", "root", "n", "left"), "near-rarest")
    a, b = first.alias("a"), first.alias("b")
    least = (F.col("a.n") + F.col("b.n")) * (similarity / (1 + similarity)) - 1e-6
    early = (F.col("a.key") < F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.left") >= least) & (F.col("b.left") >= least)
    return a.join(b, (F.col("a.h") == F.col("b.h")) & early).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()


def _distinct_hashes(data: bytes, words: int) -> np.ndarray:
    parts = [np.unique(np.array([xxhash.xxh3_64_intdigest(s) for s in some], np.uint64)) for some in shingles(data, words)]
    return (np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]).view(np.int64)


def _shingle_hashes(words: int):
    """A task that yields the sorted distinct hashes of each text's shingles."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for at in range(0, len(batch), 256):
                sets = [_distinct_hashes(x.as_py() or b"", words) for x in texts.slice(at, 256)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, 256), pa.array(sets, pa.list_(pa.int64()))], ["key", "hashes"])

    return task


def near_copies(rows: DataFrame, *, text_col: str = "text", row_col: str = "row", id_col: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """row and keep_row for every row of a stored table that is a copy or near copy of another: ``keep_row`` is the one of its group
    with the smallest id (null last), then the smallest row.

    Texts with the same words in order are merged first. Two different ones are compared if their fingerprints meet, and linked
    if the Jaccard similarity of their sets of ``words``-word shingles is at least ``similarity``; groups are chains of links.
    Whatever meets is compared, unless links join it already: first with two others; of groups that meet and are still apart, then,
    every text with each that shares one of its rarest shingles early enough, which no pair of that similarity fails to do. No
    document, no row; a null or empty text is a copy of every other one; ties of ids go to the smaller row.
    """
    named = rows.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = written(named.mapInArrow(_signatures, "row long, doc_id long, key long, f0 long, f1 long"), "near-signatures")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("row"))
    distinct = written(base.groupBy("key").agg(F.min(order).alias("best"), F.min("f0").alias("f0"), F.min("f1").alias("f1"), F.count(F.lit(1)).alias("n")), "near-distinct")
    met = distinct.select("key", "f0", "f1").mapInArrow(_emit, "key long, node long").repartition("key").sortWithinPartitions("key")
    families = written(met.mapInArrow(_families, "family long, nodes array<long>").groupBy("family").agg(F.first("nodes").alias("nodes")), "near-families")
    pairs = written(families.mapInArrow(_stars, "a long, b long").distinct(), "near-candidates")
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(distinct.select("key", F.col("best.row").alias("row")), "key")
    texts = named.select("row", "text").join(ends, "row").select("key", "text")
    hashes = written(texts.mapInArrow(_shingle_hashes(words), "key long, hashes array<long>"), "near-shingles")
    left, right = (hashes.select(F.col("key").alias(k), F.col("hashes").alias(f"{k}_hashes")) for k in ("a", "b"))
    both = F.size(F.array_intersect("a_hashes", "b_hashes"))
    jaccard = both / (F.size("a_hashes") + F.size("b_hashes") - both)
    alike = lambda found: found.join(left, "a").join(right, "b").filter(jaccard >= similarity).select("a", "b")
    links = written(alike(pairs), "near-links")
    roots = components(links).withColumnRenamed("node", "key")
    each = families.filter(F.size("nodes") > 2).select("family", F.explode("nodes").alias("key")).join(roots, "key", "left")
    labels = each.select("family", F.coalesce("root", "key").alias("root")).groupBy("family").agg(F.collect_set("root").alias("roots"))
    apart = written(labels.filter(F.size("roots") > 1).select(F.explode("roots").alias("root")).distinct(), "near-parted")
    members = hashes.select("key").join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root")).join(apart, "root", "left_semi")
    links = written(links.union(alike(_sharing(members, hashes, similarity))), "near-links")
    roots = components(links).withColumnRenamed("node", "key")
    grouped = distinct.join(roots, "key", "left").select("key", "best", F.coalesce("root", "key").alias("root"))
    kept = grouped.groupBy("root").agg(F.min("best").alias("kept"))
    table = written(grouped.select("key", "root").join(kept, "root").select("key", F.col("kept.row").alias("keep_row")), "near-kept")
    return base.select("row", "key").join(table, "key").select("row", "keep_row")


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one row of each group of copies and near copies, in the columns of ``docs``.

    Empty and null texts are copies of one another. The rows to drop are taken out by an anti join, broadcast while counted to
    be few; texts are shuffled only beyond that.
    """
    rows = written(docs.withColumn("__sf_row", F.monotonically_increasing_id()), "near-documents")
    found = near_copies(rows, text_col=text_col, row_col="__sf_row", id_col=id_col, words=words, similarity=similarity)
    dropped = written(found.filter("row <> keep_row").select(F.col("row").alias("__sf_row")), "near-dropped")
    small = dropped.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(dropped) if small else dropped.hint("merge"), "__sf_row", "left_anti").drop("__sf_row")
