"""Numpy kernels over the bytes of many texts laid end to end: q-gram
fingerprints, minimizer anchors and substring fingerprints.

A *window* is a ``width``-byte string inside one text. Its *anchor* is the
position of the smallest q-gram fingerprint among the ``width - q + 1`` q-grams
of the window (leftmost on ties), so equal windows have their anchor at the
same offset wherever they occur. Consecutive windows mostly share an anchor:
the windows of one anchor are the starts ``lo..hi``.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Fixed odd multipliers of the fingerprints (any odd constants do).
BASE = _U(0x9E3779B97F4A7C15)
MIX = _U(0xD6E8FEB86659FD93)
_POS_MASK = _U((1 << 31) - 1)  # buffers of up to 2 GiB, the most that a cell holds


def byte_values() -> np.ndarray:
    """A 64-bit value for each byte, from a splitmix sequence."""
    x = np.arange(1, 257, dtype=np.uint64) * BASE
    return mix(mix(x) + BASE)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * MIX
    x ^= x >> _U(29)
    x *= BASE
    x ^= x >> _U(32)
    return x


def _power(base: np.uint64, n: int) -> np.uint64:
    return _U(pow(int(base), n, 1 << 64))


def gram_hashes(buf: np.ndarray, q: int) -> np.ndarray:
    """Fingerprint of every q-gram of ``buf`` (uint8), by doubling."""
    level, size, out, done = byte_values()[buf], 1, None, 0
    while True:
        if q & size:
            if out is None:
                out, done = level, size
            else:  # bits are taken from low to high: the taken part goes behind the new one
                n = len(level) - done
                out, done = level[:n] * _power(BASE, done) + out[size:size + n], done + size
        if size * 2 > q:
            break
        n = len(level) - size
        level = level[:n] * _power(BASE, size) + level[size:size + n]
        size *= 2
    return mix(out[: max(0, len(buf) - q + 1)])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    level, size = values, 1
    while size * 2 <= width:
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    rest = width - size
    return np.minimum(level[: len(level) - rest], level[rest:]) if rest else level


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, q: int):
    """(position, lo, hi, fingerprint) of the anchors of all windows of the
    texts ``buf[starts[i]:ends[i]]`` (each at least ``width`` long, ascending)."""
    empty = np.zeros(0, np.int64)
    if not len(starts):
        return empty, empty, empty, np.zeros(0, np.uint64)
    grams = gram_hashes(buf, q)
    keys = (grams & ~_POS_MASK) | np.arange(len(grams), dtype=np.uint64)
    at = (window_minima(keys, width - q + 1) & _POS_MASK).astype(np.int64)
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts] += 1
    np.add.at(edge, ends - width + 1, -1)
    windows = np.flatnonzero(np.cumsum(edge)[: len(at)])
    at = at[windows]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1))))
    last = np.append(first[1:], len(at)) - 1
    pos = at[first]
    return pos, windows[first], windows[last], grams[pos]


class Substrings:
    """64-bit fingerprints of arbitrary substrings of one buffer."""

    def __init__(self, buf: np.ndarray):
        n = len(buf) + 1
        power = np.full(n, BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.inverse = np.full(n, _U(pow(int(BASE), -1, 1 << 64)), np.uint64)
        self.inverse[0] = 1
        np.cumprod(self.inverse, out=self.inverse)
        power[:-1] *= byte_values()[buf]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(power[:-1])))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64) * MIX)
