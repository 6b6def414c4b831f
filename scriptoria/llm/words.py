"""Words of a batch of texts as 64-bit hashes, by vectorized passes over the bytes.

A word is a run of ASCII letters (A-Z counts as a-z), ASCII digits and bytes from 0x80 on."""

from __future__ import annotations

import functools

import numpy as np

from scriptoria.llm import common

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20


@functools.cache
def _fold() -> np.ndarray:
    """Byte to lower-cased byte; 0 for bytes that are in no word."""
    t = np.zeros(256, np.uint8)
    for lo, hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        t[lo:hi] = np.arange(lo, hi)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = _PIECE + (1 << 16)
    up = np.full(n, _BASE, U)
    down = np.full(n, pow(_BASE, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Words:
    """data: folded bytes; start, end: each word's bytes; first: n+1 offsets of rows into the words; hashes."""

    def __init__(self, col):
        raw, off = common.bytes_of(col)
        self.data, self.off = _fold()[raw], off
        inside = self.data != 0
        opens, closes = inside.copy(), inside.copy()
        if len(raw):
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            edges = off[1:-1]
            edges = edges[(edges > 0) & (edges < len(raw))]
            opens[edges] = inside[edges]
            closes[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, off)
        self.hashes = self._hash()

    def __len__(self) -> int:
        return len(self.off) - 1

    def _hash(self) -> np.ndarray:
        up, down = _powers()
        out = np.empty(len(self.start), U)
        at = 0
        while at < len(self.start):
            base = self.start[at]
            upto = max(at + 1, int(np.searchsorted(self.end, base + _PIECE, "right")))
            size = int(self.end[upto - 1] - base)
            if size > len(up):  # one word of more than a megabyte
                out[at] = U(int.from_bytes(__import__("hashlib").blake2b(self.data[base : base + size].tobytes(), digest_size=8).digest(), "little"))
            else:
                sums = np.zeros(size + 1, U)
                np.cumsum(self.data[base : base + size].astype(U) * up[:size], dtype=U, out=sums[1:])
                s, e = self.start[at:upto] - base, self.end[at:upto] - base
                out[at:upto] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U)
            at = upto
        return mix(out)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, one space between."""
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(a, b))


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, row by row, and the rows' offsets into them. A gram's place is its first word's."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    if not out[-1]:
        return np.zeros(0, U), out
    n = len(hashes) - k + 1
    total = np.zeros(n, U)
    for i in range(k):
        total *= U(0xD6E8FEB86659FD93)
        total += hashes[i : i + n]
    places = np.arange(out[-1]) + np.repeat(first[:-1] - out[:-1], counts)
    return mix(total[places]), out


def join_hash(parts: np.ndarray) -> np.ndarray:
    """One hash for each row of a matrix, in order."""
    total = np.zeros(parts.shape[0], U)
    for i in range(parts.shape[1]):
        total = mix(total * U(0xD6E8FEB86659FD93) + parts[:, i])
    return total
