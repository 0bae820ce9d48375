"""The pre-tokenizer of byte-level BPE over whole blocks of texts, and a store of the ids of pieces.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Its cuts follow from the classes of
neighbouring characters, so a block's cuts are found with array operations and its pieces are made distinct by Arrow; only
distinct pieces are then encoded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
#: A block of texts that is cut and encoded at once has about so many bytes; a longer text is a block of its own.
BLOCK = 1 << 20


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, every):
            a, b = (x if x < 0xD800 else x + 0x800 for x in (m.start(), m.end() - 1))
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[0x20] = SPACE
    return out


def cuts(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts together, the byte offsets where pieces begin (and the end), and each text's first piece (and the number of all)."""
    data = b"".join(texts)
    raw = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    code = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(code)
    byte_ends = np.cumsum([0, *map(len, texts)])
    text_at = np.searchsorted(starts, byte_ends)  # in code points
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    kind = classes()[code]
    first = np.zeros(n + 1, bool)
    first[text_at] = True
    white = kind >= SPACE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 9, kind[:-1]
    before[first[:n]] = 9
    after_solid = np.zeros(n, bool)
    after_solid[:-1] = ~white[1:]
    after_solid &= ~first[1:]
    white_before = (before == SPACE) | (before == WHITE)
    # a run of white space is a piece but for its last character before something solid; a blank there joins what follows
    begin = np.where(white, ~white_before | after_solid, (before != kind) & (before != SPACE))
    quote = np.flatnonzero((code == 0x27) & begin)
    for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
        k = len(tail)
        at = quote[quote + k < n]
        for i, c in enumerate(tail, 1):
            at = at[(code[at + i] == ord(c)) & ~first[at + i]]
        begin[at + 1] = False
        rest = at + k + 1
        rest = rest[rest < n]
        begin[rest[kind[rest] == LETTER]] = True
    pieces = np.flatnonzero(begin)
    return data, np.append(starts[pieces], len(data)), np.searchsorted(pieces, text_at)


class Encoder:
    """Ids of texts through ids of distinct pieces. ``encode`` maps new pieces to their ids; what it gave is kept for later blocks
    up to ``most`` pieces, then forgotten, so memory stays bounded."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 400_000):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        ids = self.encode(new)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n, used = len(self.known), int(self.at[len(self.known)])
        while len(self.flat) < used + lengths.sum():
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.at) <= n + len(ids):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[used : used + lengths.sum()] = np.fromiter((x for y in ids for x in y), np.uint32, int(lengths.sum()))
        self.at[n + 1 : n + 1 + len(ids)] = used + np.cumsum(lengths)
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin (and the end)."""
        data, offsets, text_at = cuts(texts)
        if len(offsets) == 1:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) + len(words) > self.most:
            self.forget()
        if new := [w for w in words if w not in self.known]:
            self._learn(new)
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        start, length = self.at[which], self.at[which + 1] - self.at[which]
        index = coded.indices.to_numpy()
        own, counts = start[index], length[index]
        ends = np.cumsum(counts)
        total = int(ends[-1])
        ids = self.flat[np.repeat(own - (ends - counts), counts) + np.arange(total)]
        return ids, np.r_[0, ends][text_at]


def blocks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts in blocks of about ``BLOCK`` bytes."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > BLOCK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held
