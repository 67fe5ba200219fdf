"""Elias-Fano sequences and a two-level n-gram trie on them, in one flat byte string.

A non-decreasing sequence of n numbers below u keeps log2(u/n) low bits of each
number packed, and the high bits in unary.  All parts are arrays at 8-byte
offsets, so a trie is used as it lies in a buffer or a memory-mapped file.

Level one of a trie are words (64-bit hashes) with counts; level two are the
contexts in which each word was seen (32-bit hashes).  Level two is one monotone
sequence, (rank of the word, context); pointers, another monotone sequence, say
where each word's contexts begin.  A query finds the word's rank, and then the
context by successor search within the word's range.  Values are quantised to
one byte through a codebook.
"""

from __future__ import annotations

import numpy as np

_U8 = np.uint64
CONTEXT_BITS = 32


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` low bits of each value, laid end to end; 8 bytes of zero follow, for reading past the end."""
    out = np.zeros((len(values) * bits + 7) // 8 + 8, np.uint8)
    for start in range(0, len(values), 1 << 16):  # a multiple of 8 values fills whole bytes
        v = values[start : start + (1 << 16)]
        field = np.unpackbits(v.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - bits :][:, ::-1]
        part = np.packbits(field.reshape(-1), bitorder="little")
        out[start * bits // 8 : start * bits // 8 + len(part)] = part
    return out


class EliasFano:
    """Access to a stored sequence; ``at`` and ``successor`` take arrays."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits = n, bits
        self._low = np.lib.stride_tricks.as_strided(low[:8].view("<u8") if len(low) >= 8 else np.zeros(1, "<u8"), (max(1, len(low) - 7),), (1,))
        ones = np.unpackbits(high, bitorder="little")
        at = np.flatnonzero(ones)[:n]
        self.high = (at - np.arange(n)).astype(np.int64)  # select directory, unpacked when the sequence is opened
        zeros = np.flatnonzero(ones == 0)
        self._ends = zeros - np.arange(len(zeros))  # numbers before the end of each bucket of equal high bits

    @staticmethod
    def build(values: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(low bits, low part, high part) of non-decreasing numbers below ``universe``."""
        n = len(values)
        bits = min(56, max(0, (universe // max(1, n)).bit_length() - 1))
        high = (values >> _U8(bits)).astype(np.int64)
        marks = np.zeros((((universe - 1) >> bits) + 1 if universe else 1) + n + 1, np.uint8)
        marks[high + np.arange(n)] = 1
        return bits, _pack(values & _U8((1 << bits) - 1), bits) if bits else np.zeros(8, np.uint8), np.packbits(marks, bitorder="little")

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U8)
        place = np.asarray(i, np.int64) * self.bits
        return (self._low[place >> 3] >> (place & 7).astype(_U8)) & _U8((1 << self.bits) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.high[i].astype(_U8) << _U8(self.bits)) | self.low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first number that is at least x; n if there is none."""
        h = (x >> _U8(self.bits)).astype(np.int64)
        last = len(self._ends) - 1
        lo = np.where(h > 0, self._ends[np.minimum(h - 1, last)], 0).clip(0, self.n)
        hi = self._ends[np.minimum(h, last)].clip(0, self.n)
        want = x & _U8((1 << self.bits) - 1)
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = self.low(mid) < want[active]
            lo[active[less]] = mid[less] + 1
            hi[active[~less]] = mid[~less]
            active = active[lo[active] < hi[active]]
        return lo


def quantise(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(codes, codebook): bins of equal width, each standing for its mean, so no value is off by more than a bin; exact up to ``levels`` distinct values."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    known = np.unique(values)
    if len(known) > levels:
        known = np.linspace(known[0], known[-1], levels + 1)[1:]
    codes = np.searchsorted(known, values).clip(0, len(known) - 1)
    return codes.astype(np.uint8), np.bincount(codes, values, len(known)) / np.maximum(1, np.bincount(codes, minlength=len(known)))


class Trie:
    """Words with counts, and values of their contexts; opened on any buffer or memory map without copying its parts."""

    def __init__(self, buffer):
        raw = np.frombuffer(buffer, np.uint8) if not isinstance(buffer, np.ndarray) else buffer
        head = raw[:128].view("<u8").astype(np.int64).tolist()
        self.words, self.grams, b1, bp, b2 = head[:5]
        at, parts = 128, []
        for size in head[5:13]:
            parts.append(raw[at : at + size])
            at += -(-size // 8) * 8
        self.level1 = EliasFano(self.words, b1, parts[0], parts[1])
        self.pointers = EliasFano(self.words + 1, bp, parts[2], parts[3])
        self.level2 = EliasFano(self.grams, b2, parts[4], parts[5])
        self.counts = parts[6].view("<i8")
        codes = parts[7]
        self.book, self.codes = codes[: 256 * 8].view("<f8"), codes[256 * 8 :]

    @staticmethod
    def build(words: np.ndarray, counts: np.ndarray, starts: np.ndarray, contexts: np.ndarray, values: np.ndarray) -> bytes:
        """From ascending distinct words, their counts, where their contexts begin (and end), ascending contexts of each, and values."""
        n, grams = len(words), len(contexts)
        rank = np.repeat(np.arange(n, dtype=_U8), np.diff(starts))
        b1, l1, h1 = EliasFano.build(words, 1 << 64)
        bp, lp, hp = EliasFano.build(starts.astype(_U8), grams + 1)
        b2, l2, h2 = EliasFano.build((rank << _U8(CONTEXT_BITS)) | contexts.astype(_U8), max(1, n) << CONTEXT_BITS)
        codes, book = quantise(values)
        parts = [l1, h1, lp, hp, l2, h2, counts.astype("<i8").view(np.uint8), np.concatenate([np.pad(book, (0, 256 - len(book))).astype("<f8").view(np.uint8), codes])]
        head = np.array([n, grams, b1, bp, b2, *(len(p) for p in parts)] + [0] * 3, "<u8").tobytes()
        return head + b"".join(p.tobytes() + b"\0" * (-len(p) % 8) for p in parts)

    def rank(self, words: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 for unknown ones."""
        if not self.words:
            return np.full(len(words), -1, np.int64)
        i = self.level1.successor(words)
        j = np.minimum(i, self.words - 1)
        return np.where((i < self.words) & (self.level1.at(j) == words), i, -1)

    def value(self, rank: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The value of each (word's rank, context); NaN if the word was not seen there."""
        out = np.full(len(rank), np.nan)
        known = np.flatnonzero(rank >= 0)
        if self.grams and len(known):
            r = rank[known]
            x = (r.astype(_U8) << _U8(CONTEXT_BITS)) | context[known].astype(_U8)
            i = self.level2.successor(x)
            inside = i < self.pointers.at(r + 1).astype(np.int64)  # within the word's own range
            hit = np.flatnonzero(inside)[self.level2.at(i[inside]) == x[inside]]
            out[known[hit]] = self.book[self.codes[i[hit]]]
        return out
