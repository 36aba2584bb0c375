"""Numpy views of Arrow text columns: UTF-8 bytes, words, and hashes of both.

Everything works on blocks of whole documents so that temporaries stay within
a few dozen MB whatever the Arrow batch holds (a longer document is a block of
its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The whitespace bytes 0x20 and 0x09-0x0D that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240601))
#: A random 64-bit value for each byte, all different from zero.
BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Ranges of bytes are hashed as polynomials modulo this prime, whose powers of two are rotations.
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_BASE = 0x9E3779B97F4A7C15 % PRIME
_INVERSE = pow(_BASE, -1, PRIME)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    """x * 2**k modulo PRIME, for x below 2**61."""
    return ((x << np.uint64(k)) & _P) | (x >> np.uint64(61 - k))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME for values below it."""
    low = np.uint64(0xFFFFFFFF)
    ah, al, bh, bl = a >> np.uint64(32), a & low, b >> np.uint64(32), b & low
    middle, small = ah * bl + al * bh, al * bl
    return _reduced((ah * bh << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & np.uint64(0x1FFFFFFF)) << np.uint64(32)) + (small & _P) + (small >> np.uint64(61)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses, modulo PRIME."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(n - 1, 1 << 20).bit_length()
        _powers.clear()
        for base in (_BASE, _INVERSE):
            p = np.empty(size, np.uint64)
            p[0], have, step = 1, 1, base
            while have < size:  # the second half is the first times base**have
                p[have : 2 * have] = times(p[:have], np.uint64(step))
                have, step = 2 * have, step * step % PRIME
            _powers.append(p)
    return _powers[0][:n], _powers[1][:n]


class Ranges:
    """Hashes of ranges of bytes; equal content gives equal hashes wherever it stands.

    Powers are split into three parts of at most 21 bits, so that sums of them
    times a byte stay exact, and are reduced only where a range begins or ends.
    """

    def __init__(self, data: np.ndarray):
        p, self.inverse = powers(len(data) + 1)
        p, keys, part = p[: len(data)], data.astype(np.uint64) + np.uint64(1), np.uint64((1 << 21) - 1)
        self.sums = []
        for k in (0, 21, 42):
            out = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(keys * ((p >> np.uint64(k)) & part), out=out[1:])
            self.sums.append(out)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.zeros(len(start), np.uint64)
        for k, s in zip((0, 21, 42), self.sums, strict=True):
            total = total + _rotated(_reduced(s[end] - s[start]), k)
        return mix(times(_reduced(total), self.inverse[start]) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashes of values[first : first + count] for short runs: each step mixes one value in, so order counts."""
    h = count.astype(np.uint64)
    for k in range(int(count.max(initial=0))):
        on = k < count
        h = np.where(on, mix(h * np.uint64(0x9E3779B97F4A7C15) + values[np.where(on, first + k, 0)]), h)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes (and rows) together, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and for each row the index of its first word.

    ``offsets`` counts from the block's first byte. Words never cross rows.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, offsets)
