"""Vectorised word and window hashes of UTF-8 texts (numpy, inside tasks).

A hash is a polynomial in an odd base modulo 2^64 over mixed values, so that any
run of values is hashed from two prefix sums.  Equal runs have equal hashes
wherever they stand.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        a[0] = 1
        have = _POWERS[base] = np.cumprod(a)
    return have[:n]


BYTE_VALUES = mix(np.arange(256), 7)


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE^i; one entry more than the values."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def runs(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run [start, end) of the values whose prefix sums are given."""
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts])


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive values."""
    if len(values) < k:
        return np.zeros(0, dtype=np.uint64)
    s, n = prefix(values), len(values) - k + 1
    return mix((s[k:] - s[:n]) * powers(INVERSE, n))


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def spans(data: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not in ``gap``."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~gap[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(found: list[bytes], gap: np.ndarray = SPACE, fold: np.ndarray | None = None):
    """(hashes, starts, ends, first, data): the words of several texts joined by line
    breaks; ``first`` holds the number of the first word of each text, and the total."""
    data = np.frombuffer(b"\n".join(found), dtype=np.uint8)
    if fold is not None:
        data = fold[data]  # and the capitals of Latin-1, whose second byte follows 0xC3
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][capital] += 32
    starts, ends = spans(data, gap)
    offsets = np.cumsum([0, *(len(t) + 1 for t in found)])
    first = np.searchsorted(starts, offsets)
    hashes = runs(prefix(BYTE_VALUES[data]), starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)
    return hashes, starts, ends, first, data


class Vocabulary:
    """Word hashes with numbers 0.. in the given order; ``find`` gives -1 for others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.asarray(hashes, dtype=np.uint64)
        self.order = np.argsort(self.hashes, kind="stable")
        self.sorted = self.hashes[self.order]
        self.bits = min(22, max(8, int(len(self.hashes)).bit_length() + 3))
        self.present = np.zeros(1 << self.bits, dtype=bool)
        self.present[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int64)
        if not len(self.sorted):
            return out
        maybe = np.flatnonzero(self.present[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        hit = self.sorted[at] == hashes[maybe]
        out[maybe[hit]] = self.order[at[hit]]
        return out
