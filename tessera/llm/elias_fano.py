"""Elias-Fano coded monotone sequences, searched by whole arrays of queries."""

from __future__ import annotations

import numpy as np


_L8, _H8 = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_M1, _M2, _M4 = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
#: Position of the k-th (from 0) set bit of each byte; 8 where there are fewer.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.int64).ravel()


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of each word: byte sums, then a table for the byte."""
    s = word - ((word >> np.uint64(1)) & _M1)
    s = (s & _M2) + ((s >> np.uint64(2)) & _M2)
    s = ((s + (s >> np.uint64(4))) & _M4) * _L8  # each byte: set bits up to its end
    k = k.astype(np.uint64)
    byte = np.bitwise_count(((k * _L8 | _H8) - s) & _H8).astype(np.uint64) << np.uint64(3)
    inside = k - ((s << np.uint64(8)) >> byte & np.uint64(255))
    return byte.astype(np.int64) + _IN_BYTE[((word >> byte & np.uint64(255)) << np.uint64(3) | inside).astype(np.int64)]


def _low_ones(word: np.ndarray) -> np.ndarray:
    """How many of each word's lowest bits are set without a gap."""
    return np.where(word == ~np.uint64(0), 64, np.bitwise_count((word ^ (word + np.uint64(1))) >> np.uint64(1)).astype(np.int64))


class EliasFano:
    """n non-decreasing values below a bound in about log2(bound / n) + 2 bits each, plus rank directories of one bit.

    The low bits lie packed; the high ones are unary, a zero closing each bucket of equal high bits.
    """

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.low_bits = (int(x) for x in parts["meta"][:2])
        self.lows, self.highs, self.zeros = parts["lows"], parts["highs"], parts["zeros"]
        self._ones: np.ndarray | None = None

    @staticmethod
    def encode(values: np.ndarray, bound: int) -> dict[str, np.ndarray]:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, (int(bound) // max(1, n)).bit_length() - 1)
        places = np.arange(n, dtype=np.int64)
        high = (values >> np.uint64(low_bits)).astype(np.int64) if low_bits < 64 else np.zeros(n, np.int64)
        buckets = int(high[-1]) + 1 if n else 1
        highs = np.zeros((n + buckets) // 64 + 2, np.uint64)
        at = high + places
        np.bitwise_or.at(highs, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        # Bits beyond the last bucket's zero stay zero: they read as empty buckets.
        lows = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            low = values & np.uint64((1 << low_bits) - 1)
            bit = places * low_bits
            shift = (bit & 63).astype(np.uint64)
            np.bitwise_or.at(lows, bit >> 6, low << shift)
            spill = shift + np.uint64(low_bits) > 64
            np.bitwise_or.at(lows, (bit[spill] >> 6) + 1, low[spill] >> (np.uint64(64) - shift[spill]))
        zeros = np.zeros(len(highs) + 1, np.uint32 if len(highs) < 1 << 26 else np.uint64)
        np.cumsum(64 - np.bitwise_count(highs).astype(np.int64), out=zeros[1:], dtype=zeros.dtype)
        return {"meta": np.array([n, low_bits], np.int64), "lows": lows, "highs": highs, "zeros": zeros}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        first = self.lows[word] >> shift
        rest = np.where(shift > 0, self.lows[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (first | rest) & np.uint64((1 << self.low_bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Bit position of the k-th zero (from 0); the end where there are fewer."""
        total = int(self.zeros[-1])
        word = np.searchsorted(self.zeros, np.minimum(k, total - 1).astype(self.zeros.dtype), "right") - 1
        inside = np.minimum(k, total - 1) - self.zeros[word].astype(np.int64)
        return word * 64 + _select(~self.highs[word], inside)

    def _one(self, k: np.ndarray) -> np.ndarray:
        """Bit position of the k-th one (from 0)."""
        if self._ones is None:
            self._ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros.astype(np.int64)
        word = np.searchsorted(self._ones, k, "right") - 1
        return word * 64 + _select(self.highs[word], k - self._ones[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        at = self._one(i)
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def _next_one(self, at: np.ndarray) -> np.ndarray:
        """Position of the first set bit after a position, where there is one."""
        word = (at >> 6).copy()
        bits = self.highs[word] & (~np.uint64(1) << (at & 63).astype(np.uint64))
        empty = np.flatnonzero(bits == 0)
        while len(empty):
            word[empty] += 1
            bits[empty] = self.highs[word[empty]]
            empty = empty[bits[empty] == 0]
        return word * 64 + np.bitwise_count((bits & (np.uint64(0) - bits)) - np.uint64(1)).astype(np.int64)

    def _ones_from(self, at: np.ndarray) -> np.ndarray:
        """How many bits from a position on are set without a gap."""
        bit = (at & 63).astype(np.uint64)
        run = _low_ones(self.highs[at >> 6] >> bit)
        full = np.flatnonzero(run == 64 - bit.astype(np.int64))
        while len(full):  # to the end of its word, and on
            add = _low_ones(self.highs[(at[full] + run[full]) >> 6])
            run[full] += add
            full = full[add == 64]
        return run

    def spans(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at positions and at those after them."""
        at = self._one(i)
        after = self._next_one(at)
        high = np.uint64(self.low_bits)
        return ((at - i).astype(np.uint64) << high) | self._low(i), ((after - i - 1).astype(np.uint64) << high) | self._low(i + 1)

    def all(self) -> np.ndarray:
        bits = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.highs).view(np.uint8), bitorder="little"))[: self.n]
        places = np.arange(self.n, dtype=np.int64)
        return ((bits - places).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(places)

    def find(self, targets: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Position of each target (within [begin, end) if given), -1 where it is absent: successor search, then equality."""
        if not self.n or not len(targets):
            return np.full(len(targets), -1, np.int64)
        targets = np.asarray(targets, np.uint64)
        high = (targets >> np.uint64(self.low_bits)).astype(np.int64)
        low = targets & np.uint64((1 << self.low_bits) - 1)
        total = int(self.zeros[-1])
        # The ones of a bucket lie between the zeros before and after it.
        start = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1, 0)
        beyond = high >= total
        lo = np.where(beyond, self.n, start - high)
        hi = np.where(beyond, self.n, np.minimum(start - high + self._ones_from(np.where(beyond, 0, start)), self.n))
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        stop = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        there = lo < stop
        safe = np.where(there, lo, 0)
        return np.where(there & (self._low(safe) == low), safe, -1)
