"""Word shingle sets of whole texts as 64-bit hashes, vectorised over many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

SIZE = 5
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_CODES = np.random.Generator(np.random.PCG64(20240101)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_CHUNK = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64), _BASE, np.uint64)
        p[0] = 1
        _powers = np.cumprod(p)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of lower-case bytes."""
    word = ~_BLANK[data]
    edges = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = ends - starts
    places = np.flatnonzero(word)
    within = places - np.repeat(starts, lengths)
    values = _CODES[data[places]] * _power(int(lengths.max()))[within]
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64) * np.uint64(_ODD[0])), starts


def _long(data: bytes) -> np.ndarray:
    """Word hashes of one long text, in chunks that end at blanks."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        out.append(_words(_LOWER[np.frombuffer(data[at:end], np.uint8)])[0])
        at = end
    return np.concatenate(out)


def _set(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words)
    if not n:
        return words
    if n < size:
        h = np.uint64(n)
        for k in range(n):
            h = h + words[k] * np.uint64(_ODD[k])
        return mix(np.asarray([h], np.uint64))
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h += words[k : n - size + 1 + k] * np.uint64(_ODD[k])
    return np.unique(mix(h))


def shingle_sets(texts: list[str | None], size: int = SIZE) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; fewer words than ``size`` make one shingle."""
    with np.errstate(over="ignore"):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        short = [b if len(b) <= _CHUNK else b"" for b in raw]
        hashes, starts = _words(_LOWER[np.frombuffer(b"\n".join(short) + b"\n", np.uint8)])
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(b) + 1 for b in short]))
        return [_set(hashes[a:b] if len(raw[i]) <= _CHUNK else _long(raw[i]), size) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]


def digest(tokens: np.ndarray) -> bytes:
    """A 128-bit digest of a set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
