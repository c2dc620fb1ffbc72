"""Word and shingle hashing over whole Arrow batches, in numpy.

Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D after lower-casing
A-Z; `bytes.lower().split()` is exactly that.  Every hash here is a fixed function of
the bytes (no per-process seed), so any executor computes the same value.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # odd, hence invertible modulo 2**64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=_U) * _GOLDEN)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = {True: np.ones(1, _U), False: np.ones(1, _U)}


def _powers(n: int, inverse: bool) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table only ever grows to the largest batch."""
    have = _POWERS[inverse]
    if len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.full(size, base, _U)
        out[0] = 1
        have = _POWERS[inverse] = np.multiply.accumulate(out)
    return have[:n]


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash per word of `text`, in order."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.empty(0, _U)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, _U)
    out = np.empty(len(start), _U)
    step = 1 << 20  # texts of any length in windows of about a megabyte
    at = 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(end, start[at] + step, "right")))
        lo, hi = int(start[at]), int(end[upto - 1])
        code = _BYTE_CODE[_LOWER[raw[lo:hi]]]
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(code * _powers(hi - lo, False), out=total[1:])
        s, e = start[at:upto] - lo, end[at:upto] - lo
        out[at:upto] = mix64((total[e] - total[s]) * _powers(hi - lo, True)[s] + (e - s).astype(_U) * _GOLDEN)
        at = upto
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words; of the whole sequence if it is shorter."""
    if not len(words):
        return np.empty(0, _U)
    width = min(n, len(words))
    count = len(words) - width + 1
    h = np.full(count, width, _U)
    for k in range(width):
        h = mix64((h + words[k : k + count]) * _U(_BASE) + _GOLDEN)
    return h


def _distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) > 1 else h


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct n-word shingle hashes of a whole text."""
    return _distinct(gram_hashes(word_hashes((text or "").encode("utf-8", "replace")), n))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """`shingle_set` of every text; short texts are hashed together, in runs of about a megabyte."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    out: list[np.ndarray] = []
    run: list[bytes] = []
    size = 0
    for r in raw:
        run.append(r)
        size += len(r)
        if size >= 1 << 19:
            out += _together(run, n)
            run, size = [], 0
    return out + _together(run, n) if run else out


def _together(raw: list[bytes], n: int) -> list[np.ndarray]:
    words = word_hashes(b"\n".join(raw))
    counts = np.array([len(r.split()) for r in raw])
    first = np.cumsum(counts) - counts
    if len(words) < n:
        grams = np.empty(0, _U)
    else:
        grams = gram_hashes(words, n)
    out = []
    for at, k in zip(first.tolist(), counts.tolist()):
        out.append(_distinct(grams[at : at + k - n + 1]) if k >= n else gram_hashes(words[at : at + k], n))
    return out
