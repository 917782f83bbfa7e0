"""Vectorised fingerprints over the bytes of many texts at once (NumPy inside Spark tasks).

Substring fingerprints are polynomial: every byte has a fixed random 64-bit value, a running sum of
value times power gives any substring's fingerprint by one subtraction, modulo 2**64; a mixing step
spreads it over all 64 bits.  Equal bytes always give equal fingerprints; different ones collide with
a chance of about 2**-57 a pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: Words are runs of bytes other than these (space, tab to carriage return).
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
#: Texts are worked on in pieces of about so many bytes; it bounds a task's memory and changes no result.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C55
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def byte_values(lower: bool) -> np.ndarray:
    """A random 64-bit value per byte; with ``lower`` A-Z have those of a-z."""
    v = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
    if lower:
        v[65:91] = v[97:123]
    return v


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(n, U(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    size = 1 << max(12, int(n).bit_length())
    p, q = _powers(size)
    return p[:n], q[:n]


class Fingerprints:
    """Fingerprints of any ranges ``[start, end)`` of a sequence of values."""

    def __init__(self, values: np.ndarray):
        p, self._inverse = powers(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * p[:-1], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(raw + (end - start).astype(U) * U(0xA24BAED4963EE407))


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row it is in; a word ends with its row at the latest.

    ``breaks``: of each byte, whether it stands between words."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    black = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = black.copy()
    first[1:] &= ~black[:-1] | edge[1:-1]
    last = black.copy()
    last[:-1] &= ~black[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, side="right") - 1


def text_pieces(data: np.ndarray, a: int, b: int):
    """Ranges of about ``PIECE`` bytes of ``data[a:b]`` that end at white space, so no word is cut.

    Only a single word longer than a piece makes a longer range."""
    while a < b:
        c = min(a + PIECE, b)
        while c < b:
            white = np.flatnonzero(WHITE[data[a:c]])
            if len(white):
                c = a + int(white[-1]) + 1
                break
            c = min(c + PIECE, b)
        yield a, c
        a = c


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, breaks: np.ndarray = WHITE):
    """Fingerprint, start, end and row of every word of the rows, in order."""
    values, parts = byte_values(lower), []
    if len(offsets) == 2:  # a row alone may be long
        ranges = [(a, c, np.array([0, c - a])) for a, c in text_pieces(data, int(offsets[0]), int(offsets[1]))]
    else:
        ranges = [(int(offsets[0]), int(offsets[-1]), offsets - offsets[0])]
    for a, c, off in ranges:
        s, e, row = words(data[a:c], off, breaks)
        parts.append((Fingerprints(values[data[a:c]])(s, e), s + a, e + a, row))
    if not parts:
        z = np.zeros(0, np.int64)
        return z.astype(U), z, z, z
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
