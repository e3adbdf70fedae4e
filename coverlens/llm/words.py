"""Words and word hashes of many texts at once, in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def byte_values() -> np.ndarray:
    """A fixed random 64-bit number for each byte."""
    return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


@cache
def is_blank() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


_ODD = 0x2545F4914F6CDD1D
_STEP = 4_096


@cache
def _powers(step: int, base: int) -> np.ndarray:
    out = np.full(step, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int = _ODD) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    small = _powers(_STEP, base)
    if n <= _STEP:
        return small[:n]
    large = _powers(-(-n // _STEP), pow(base, _STEP, 1 << 64))
    return (large[:, None] * small[None, :]).ravel()[:n]


def words(raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that are no ASCII blank) of texts that lie end to end in ``raw``.

    Returns each word's first byte, the byte after it, and the number of words before each text (one entry more than texts).
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(begin), np.int64)
    solid = ~is_blank()[raw]
    edge = np.zeros(n + 1, bool)  # a text begins here, or the last one has ended
    edge[begin] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(start, begin, side="left")


def word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes' random values, mixed; independent of where the word stands."""
    if not len(start):
        return np.zeros(0, _U)
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(byte_values()[raw] * powers(len(raw)), out=total[1:])
    inverse = pow(_ODD, -1, 1 << 64)
    down = powers(len(raw) + 1, inverse)
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(_U))


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` neighbours of ``h`` (one for each start; none if there are fewer), independent of where it stands."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    base = _ODD ^ (seed * 0x5851F42D4C957F2C & (1 << 64) - 2) | 1
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(mix(h + _U(seed)) * powers(len(h), base), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(n, pow(base, -1, 1 << 64)))
