"""A compact n-gram trie: Elias-Fano levels over numpy, in one buffer.

Levels: the contexts (ascending ids), pointers from each context to its first
successor (monotone, so Elias-Fano as well), the successors of all contexts, and
one quantised probability for each successor.  Successor ids start anew in every
context; adding context number x universe makes the whole level ascending, and a
lookup is a successor search relative to its context.  The buffer can be a bytes
object, an Arrow column or a memory-mapped file; nothing is unpacked.
"""
from __future__ import annotations

import mmap
import struct

import numpy as np

#: Probabilities are kept as -log10 in steps of 1 / STEPS, rounded so that none grows.
STEPS = 1000
ABSENT = 65535

_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
_PLACE = np.full((256, 8), 8, np.int64)  # place of the k-th one bit of a byte
for _b in range(256):
    _PLACE[_b, :_ONES[_b]] = [i for i in range(8) if _b >> i & 1]


class EliasFano:
    """An ascending sequence of non-negative integers."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        ones = _ONES[high]
        self._ones = np.concatenate([[0], np.cumsum(ones)])
        self._zeros = np.arange(len(self._ones), dtype=np.int64) * 8 - self._ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> "EliasFano":
        values, n = values.astype(np.int64), len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        unary = np.zeros(n + (int(universe) >> bits) + 9, np.uint8)
        unary[(values >> bits) + np.arange(n)] = 1
        low = np.empty((n, bits), np.uint8)
        for k in range(bits):
            low[:, k] = (values >> k) & 1
        packed = np.packbits(low.ravel(), bitorder="little")
        return cls(n, bits, np.concatenate([packed, np.zeros(8, np.uint8)]), np.packbits(unary, bitorder="little"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        # the 8 bytes from each place on as one number; build() leaves 8 bytes behind the last
        each = np.ndarray(len(self.low) - 7, "<u8", buffer=self.low, strides=(1,))
        window = each[at >> 3] >> (at & 7).astype(np.uint64)
        return (window & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _select(self, cum: np.ndarray, flip: int, k: np.ndarray) -> np.ndarray:
        byte = np.searchsorted(cum, k, "right") - 1
        return byte * 8 + _PLACE[self.high[byte] ^ flip, k - cum[byte]]

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self._select(self._ones, 0, i) - i) << self.bits | self._low(i)

    def search(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x (n if there is none), for each x."""
        h = np.minimum(x >> self.bits, len(self.high) * 8 - self.n - 2)
        lo = np.where(h > 0, self._select(self._zeros, 255, np.maximum(h - 1, 0)) - (h - 1), 0)
        hi = self._select(self._zeros, 255, h) - h
        want = x & ((1 << self.bits) - 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high]


class Trie:
    """Two levels below the root: contexts and their successors."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray, width: int):
        self.contexts, self.pointers, self.successors, self.codes, self.width = contexts, pointers, successors, codes, width

    @classmethod
    def build(cls, u: np.ndarray, w: np.ndarray, p: np.ndarray) -> "Trie":
        """From n-grams (u, w) in ascending order without repeats and their probabilities."""
        ids, first = np.unique(u, return_index=True)
        width = int(w.max()) + 1 if len(w) else 1
        at = np.repeat(np.arange(len(ids)), np.diff(np.append(first, len(u))))
        codes = np.minimum(np.ceil(-np.log10(p) * STEPS), ABSENT - 1).astype("<u2")
        return cls(EliasFano.build(ids, int(ids.max()) + 1 if len(ids) else 1),
                   EliasFano.build(np.append(first, len(u)), len(u) + 1),
                   EliasFano.build(at * width + w, len(ids) * width + 1), codes, width)

    def lookup(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The code of each (u, w); ABSENT where the trie does not hold it."""
        out = np.full(len(u), ABSENT, np.uint16)
        if not self.contexts.n:
            return out
        k = self.contexts.search(u)
        some = np.flatnonzero((k < self.contexts.n) & (w < self.width))
        some = some[self.contexts.get(k[some]) == u[some]]
        x = k[some] * self.width + w[some]
        i = self.successors.search(x)
        inside = i < self.pointers.get(k[some] + 1)
        some, x, i = some[inside], x[inside], i[inside]
        hit = self.successors.get(i) == x
        out[some[hit]] = self.codes[i[hit]]
        return out

    def to_bytes(self) -> bytes:
        levels = (self.contexts, self.pointers, self.successors)
        parts = [a for e in levels for a in e.parts()] + [self.codes.view(np.uint8)]
        head = struct.pack("<q", self.width) + b"".join(struct.pack("<qq", e.n, e.bits) for e in levels) \
            + b"".join(struct.pack("<q", a.nbytes) for a in parts)
        return head + b"".join(a.tobytes() for a in parts)

    @classmethod
    def from_buffer(cls, buffer) -> "Trie":
        data = np.frombuffer(buffer, np.uint8)
        head = struct.unpack("<14q", data[:112].tobytes())
        at, arrays = 112, []
        for size in head[7:]:
            arrays.append(data[at:at + size])
            at += size
        levels = [EliasFano(head[1 + 2 * i], head[2 + 2 * i], arrays[2 * i], arrays[2 * i + 1]) for i in range(3)]
        codes = arrays[6]
        return cls(*levels, codes.view("<u2") if codes.flags.aligned else np.frombuffer(codes.tobytes(), "<u2"), head[0])

    @classmethod
    def open(cls, path: str) -> "Trie":
        """Maps a file written with the result of to_bytes()."""
        with open(path, "rb") as f:
            return cls.from_buffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
