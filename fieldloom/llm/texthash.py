"""Vectorised hashing of words and windows in concatenated UTF-8 text."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)


def _table() -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BYTES = _table()
_powers: dict[str, np.ndarray] = {}


def _pow(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base & _MASK, np.uint64)
        out[0] = 1
        have = _powers[name] = np.multiply.accumulate(out)
    return have[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """P with P[e]-P[s] the polynomial sum of data[s:e] (mod 2^64), to be shifted by the inverse power of s."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * _pow("b", _BASE, len(data)), out=out[1:], dtype=np.uint64)
    return out


def spans(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]], whatever stands around them; the length is part of the hash."""
    inv = _pow("i", _INV, len(p))
    return mix((p[ends] - p[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes with is_word[byte], cut at the rows' borders."""
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = offsets[1:-1] - 1
    before = before[before >= 0]
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def ascii_lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def gather(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[offsets[w]:offsets[w+1]] for each w of `which`, end to end; and the offsets of that."""
    lens = offsets[which + 1] - offsets[which]
    out = np.zeros(len(which) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    at = np.repeat(offsets[which] - out[:-1], lens)
    at += np.arange(out[-1])
    return values[at], out
