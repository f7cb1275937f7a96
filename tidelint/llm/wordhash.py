"""Words of UTF-8 texts and 64-bit digests of words and word windows, with numpy.

A word is a run of bytes other than space and 0x09 to 0x0D. Digests are
polynomials modulo 2^64 taken from one running sum, then mixed. Such
polynomials collide on some patterns of 1,024 terms and more, whatever their
base, so words of more than 64 bytes are digested by BLAKE2 instead; windows are
of few words.
"""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20_240_117)).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}
_POWERS: dict[tuple[str, bool], np.ndarray] = {}
#: Bytes hashed at a time, so that a very long text needs no more memory than a short one.
_STEP = 1 << 19
_LONG = 64


def powers(kind: str, inverse: bool, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, of the base or its inverse."""
    known = _POWERS.get((kind, inverse))
    if known is None or len(known) < n:
        base = pow(_BASE[kind], -1, 2**64) if inverse else _BASE[kind]
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        known = _POWERS[kind, inverse] = np.cumprod(grown, dtype=np.uint64)
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last, and first word of each row (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = solid[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = solid[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _STEP, "right")))
        low, high = int(starts[at]), int(ends[stop - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * powers("byte", False, high - low), out=sums[1:])
        a, b = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mixed((sums[b] - sums[a]) * powers("byte", True, high - low + 1)[a] + (b - a).astype(np.uint64))
        at = stop
    for i in np.flatnonzero(ends - starts > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return out


def window_digests(words: np.ndarray, width: int) -> np.ndarray:
    """Digest of `width` words from each position; windows may run over rows, see `inside`."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers("word", False, len(words)), out=sums[1:])
    return mixed((sums[width:] - sums[:n]) * powers("word", True, n))


def inside(firsts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of `n` window positions stay within their row."""
    ok = np.ones(n, bool)
    for back in range(1, width):
        edge = firsts[1:-1] - back
        ok[edge[(edge >= 0) & (edge < n)]] = False
    return ok
