"""Words of Arrow text columns as numpy arrays, without a Python object for each word or document.

A word is `[^\\x20\\x09-\\x0D]+`. Texts are handled whole, in chunks of about `CHUNK` bytes and at most `ROWS` rows; a longer text is a chunk of its own.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
#: most rows of a chunk
ROWS = 1 << 15
#: bytes hashed at a time, and keys that a table asks for at a time
SLICE, STEP = 1 << 20, 1 << 16
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix((np.arange(256, dtype=U) + U(1)) * BASE)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, SLICE + 1)
        up = np.full(size, base, U)
        down = np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _powers[base] = got = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return got


POLY = 0xD1342543DE82EF95


@dataclass
class Words:
    """Rows first to last of a batch: bytes, and the words' starts, ends and document (0 is the first row)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __post_init__(self):
        self.n_docs = self.last - self.first
        #: place of each document's first word, and after the last
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, from its bytes alone."""
        out = np.empty(len(self.starts), U)
        i = 0
        while i < len(out):
            base = self.starts[i]
            # words within a slice; a longer word gets a slice of its own
            j = max(i + 1, int(np.searchsorted(self.ends, base + SLICE, "right")))
            s, e = self.starts[i:j] - base, self.ends[i:j] - base
            part = self.data[base : base + e[-1]]
            up, down = powers(POLY, len(part) + 1)
            total = np.empty(len(part) + 1, U)
            total[0] = 0
            np.cumsum(BYTES[part] * up[: len(part)], out=total[1:])
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
            i = j
        return out

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def texts(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    col = col.fill_null("") if col.null_count else col
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def split(batch: pa.RecordBatch, column: str = "text", lower: bool = False, chunk: int = CHUNK) -> Iterator[Words]:
    data, off = texts(batch, column)
    first, n = 0, len(off) - 1
    while first < n:
        last = min(n, first + ROWS, max(first + 1, int(np.searchsorted(off, off[first] + chunk, "right")) - 1))
        part, o = data[off[first] : off[last]], off[first : last + 1] - off[first]
        if lower:
            part = LOWER[part]
        yield Words(first, last, part, o, *spans(part, o))
        first = last


def spans(part: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a document's edge ends a word."""
    inside = np.zeros(len(part) + 2, bool)
    np.logical_not(SPACE[part], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edge = o[1:-1]
    edge = edge[(edge > 0) & (edge < len(part))]
    begins[edge] = inside[1:-1][edge]
    stops[edge - 1] = inside[1:-1][edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive entries, in order."""
    if len(h) < n:
        return np.zeros(0, U)
    if n <= 8:
        out = h[: len(h) - n + 1].copy()
        for j in range(1, n):
            out = out * U(0xA0761D6478BD642F) + h[j : len(h) - n + 1 + j]
        return mix(out)
    up, down = powers(0xA0761D6478BD642F, len(h) + 1)
    total = np.empty(len(h) + 1, U)
    total[0] = 0
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def window_starts(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where n consecutive words lie in one document, and that document."""
    room = np.maximum(np.diff(bounds) - n + 1, 0)
    doc = np.repeat(np.arange(len(room)), room)
    ahead = np.cumsum(room) - room
    return np.arange(room.sum()) - ahead[doc] + bounds[:-1][doc], doc


class Memo:
    """An open-addressing table from 64-bit keys to rows of numbers, with all steps vectorised. It forgets all when it is three quarters full, so its memory is bounded."""

    def __init__(self, bits: int = 20, width: int = 1, dtype=np.int32):
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, U)
        self.values = np.zeros((1 << bits, width), dtype)
        self.used = 0

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it is missing. Key 0 counts as 1."""
        h = np.where(h == 0, U(1), h)
        at = (mix(h) & U(self.mask)).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        there = self.keys[at]
        hit = there == h
        out[hit] = at[hit]
        todo = np.flatnonzero(~hit & (there != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            there = self.keys[at[todo]]
            hit = there == h[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (there != 0)]
        return out

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """Distinct new keys, at most half the table's size."""
        if len(h) > self.mask // 2:
            raise ValueError("more keys at once than half the table")
        if self.used + len(h) > 3 * (self.mask + 1) // 4:
            self.keys[:] = 0
            self.used = 0
        h = np.where(h == 0, U(1), h)
        at = (mix(h) & U(self.mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            # of keys that want one slot, the first gets it
            slot, which = np.unique(at[free], return_index=True)
            self.keys[slot] = h[free[which]]
            self.values[slot] = values[free[which]]
            placed = np.zeros(len(h), bool)
            placed[free[which]] = True
            todo = todo[~placed[todo]]
            at[todo] = (at[todo] + 1) & self.mask
        self.used += len(h)

    def get(self, h: np.ndarray, make) -> np.ndarray:
        """Values of all keys; make(places of distinct missing keys) gives the missing ones, at most `STEP` at a time.

        Known values are read before anything is forgotten and new ones are not read back, so a call may have more keys than the table holds.
        """
        at = self.slots(h)
        lost = np.flatnonzero(at < 0)
        out = self.values[np.maximum(at, 0)]
        if len(lost):
            _, first, which = np.unique(h[lost], return_index=True, return_inverse=True)
            new = lost[first]
            made = np.concatenate([np.asarray(make(new[i : i + STEP])).reshape(-1, out.shape[1]) for i in range(0, len(new), STEP)]).astype(out.dtype)
            out[lost] = made[which]
            some = slice(0, self.mask // 2)
            self.put(h[new[some]], made[some])
        return out
