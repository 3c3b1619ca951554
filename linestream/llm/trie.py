"""A two-level n-gram trie of Elias-Fano coded levels with quantised values."""

from __future__ import annotations

import numpy as np

#: Bits of a successor's hash within its context, and levels of the quantised values.
WORD_BITS, LEVELS = 40, 256


class EliasFano:
    """A sorted array of 64-bit numbers in about 2 + log2(range / length) bits each, in one byte buffer.

    Each number is cut in a low part, kept as it is, and a high part, kept as the gaps between numbers in unary.  The buffer
    can lie in memory or in a mapped file: opening it copies nothing but the places of the unary bits.
    """

    def __init__(self, buffer: bytes):
        head = np.frombuffer(buffer, np.int64, 3)
        self.n, self.low_bits, high_bytes = (int(x) for x in head)
        self._high = np.frombuffer(buffer, np.uint8, high_bytes, 24)
        self._low = np.frombuffer(buffer, np.uint8, -1, 24 + high_bytes)
        bits = np.unpackbits(self._high)
        self._ones = np.flatnonzero(bits)[: self.n] - np.arange(self.n)  # high part of each number
        self._starts = np.searchsorted(self._ones, np.arange(int(self._ones[-1]) + 2)) if self.n else np.zeros(2, np.int64)

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (v >> np.uint64(low_bits)).astype(np.int64)
        unary = np.zeros((int(high[-1]) if n else 0) + n + 1, np.uint8)
        unary[high + np.arange(n)] = 1
        packed = np.packbits(unary)
        shifts = np.arange(low_bits, dtype=np.uint64)[::-1]
        low = [np.packbits(((v[i : i + (1 << 16)][:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()) for i in range(0, n, 1 << 16)]
        head = np.array([n, low_bits, len(packed)], np.int64)
        return head.tobytes() + packed.tobytes() + b"".join(x.tobytes() for x in low) + b"\0" * 16

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        first = i.astype(np.int64) * self.low_bits
        eight = np.empty((len(i), 8), np.uint8)
        for k in range(8):
            eight[:, k] = self._low[(first >> 3) + k]
        skip = (first & 7).astype(np.uint64)
        low = eight.view(">u8").ravel().astype(np.uint64) << skip
        if self.low_bits > 57:
            low |= self._low[(first >> 3) + 8].astype(np.uint64) >> (np.uint64(8) - skip)
        low = low >> np.uint64(64 - self.low_bits) if self.low_bits else np.zeros(len(i), np.uint64)
        return (self._ones[i].astype(np.uint64) << np.uint64(self.low_bits)) | low

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each ``x`` between ``begin`` and ``end``, or -1: a successor search within the numbers of its high part."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        high = x >> np.uint64(self.low_bits)
        todo = np.flatnonzero(high <= np.uint64(self._ones[-1]))
        h = high[todo].astype(np.int64)
        lo, hi = self._starts[h], self._starts[h + 1]
        if begin is not None:
            lo, hi = np.maximum(lo, begin[todo]), np.minimum(hi, end[todo])
        limit = hi
        while len(todo):  # halves the ranges until each is its first number not below x
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi) // 2
            less = np.zeros(len(todo), bool)
            less[open_] = self.at(mid[open_]) < x[todo[open_]]
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        inside = np.flatnonzero(lo < limit)
        hit = self.at(lo[inside]) == x[todo[inside]]
        out[todo[inside[hit]]] = lo[inside[hit]]
        return out


class NgramTrie:
    """Contexts, pointers to their successors, successors relative to their context, and a quantised value of each."""

    def __init__(self, contexts: bytes, pointers: bytes, words: bytes, codes: bytes, low: float, step: float):
        self.contexts, self.pointers, self.words = EliasFano(contexts), EliasFano(pointers), EliasFano(words)
        self.codes, self.low, self.step = np.frombuffer(codes, np.uint8), low, step

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, value: np.ndarray) -> NgramTrie:
        """From n-grams sorted by context, then word (``WORD_BITS`` bits), without repeats."""
        new = np.append(True, context[1:] != context[:-1]) if len(context) else np.zeros(0, bool)
        starts = np.append(np.flatnonzero(new), len(context))
        rank = (np.cumsum(new) - 1).astype(np.uint64)
        low = float(value.min(initial=np.inf)) if len(value) else 0.0
        step = max((float(value.max()) - low) / (LEVELS - 1), 1e-12) if len(value) else 1.0
        codes = np.rint((value - low) / step).astype(np.uint8)
        relative = (rank << np.uint64(WORD_BITS)) | word
        return cls(
            EliasFano.encode(context[starts[:-1]]), EliasFano.encode(starts), EliasFano.encode(relative), codes.tobytes(), low, step
        )

    def places(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each n-gram among all; -1 where the trie has none."""
        out = np.full(len(context), -1, np.int64)
        node = self.contexts.find(context)
        here = np.flatnonzero(node >= 0)
        begin, end = (self.pointers.at(node[here] + k).astype(np.int64) for k in (0, 1))
        relative = (node[here].astype(np.uint64) << np.uint64(WORD_BITS)) | word[here]
        out[here] = self.words.find(relative, begin, end)
        return out

    def values(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The value of each n-gram; nan where the trie has none."""
        out, place = np.full(len(context), np.nan), self.places(context, word)
        hit = place >= 0
        out[hit] = self.low + self.codes[place[hit]] * self.step
        return out
