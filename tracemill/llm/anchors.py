"""Content-defined anchors of byte strings, so that equal substrings are met at equal places.

Every substring of ``LENGTH`` bytes holds an anchor: the place of the least hash of ``GRAM`` bytes in it.
Equal substrings have equal anchors, wherever they lie. An anchor's context is all that a substring of
``LENGTH`` bytes around it can reach: ``LEFT`` bytes before and ``LENGTH`` from it on, cut at the text's ends.
"""

from __future__ import annotations

import numpy as np

LENGTH, GRAM = 50, 16
WIDTH = LENGTH - GRAM + 1
LEFT = WIDTH - 1
_PAD = 64
_CHUNK = 1 << 19
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _slide(x: np.ndarray, pick) -> np.ndarray:
    """pick over x[i : i + WIDTH] at i, by doubling; the end is short."""
    span = 1
    while 2 * span <= WIDTH:
        x = pick(x[: len(x) - span], x[span:])
        span *= 2
    return pick(x[: len(x) - (WIDTH - span)], x[WIDTH - span :]) if span < WIDTH else x


def _pieces(raws: list[bytes]):
    """(text, bytes, place of these in the text, first and last + 1 start of a substring to look at)."""
    for i, raw in enumerate(raws):
        last = len(raw) - LENGTH + 1
        for a in range(0, max(0, last), _CHUNK):
            b = min(a + _CHUNK, last)
            s, e = max(0, a - _PAD), min(len(raw), b + LENGTH + _PAD)
            yield i, raw[s:e], s, a - s, b - s


def _scan(pieces: list[tuple], sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    starts, at = [], _PAD
    for _, data, *_ in pieces:
        starts.append(at)
        at += len(data) + _PAD
    n = (at + _PAD + 7) // 8 * 8
    data = np.zeros(n + 64, np.uint8)
    valid = np.zeros(n, bool)
    for start, (_, piece, _, lo, hi) in zip(starts, pieces):
        data[start : start + len(piece)] = np.frombuffer(piece, np.uint8)
        valid[start + lo : start + hi] = True
    word = np.empty(n, np.uint64)
    for s in range(8):
        word[s::8] = np.frombuffer(data, "<u8", n // 8, s)
    h = word[:-8] * _A
    h ^= h >> _U(29)
    h = mix((h ^ word[8:]) * _B) | _U(1)
    least = _slide(h, np.minimum)
    least = np.where(valid[: len(least)], least, _U(0))
    reached = _slide(np.concatenate([np.zeros(LEFT, np.uint64), least]), np.maximum)
    place = np.flatnonzero((reached == h[: len(reached)]) & (reached > 0))
    which = np.searchsorted(starts, place, side="right") - 1
    text = np.asarray([p[0] for p in pieces])[which]
    pos = place - np.asarray(starts)[which] + np.asarray([p[2] for p in pieces])[which]
    left, right = np.minimum(LEFT, pos), np.minimum(LENGTH, sizes[text] - pos)
    c = (left | right << 8).astype(np.uint64) * _A
    for k in range(-LEFT, LENGTH, 8):
        w = word[place + k]
        if k + 8 > LENGTH:
            w = w & _U((1 << 8 * (LENGTH - k)) - 1)
        c = (c ^ w) * _C
        c ^= c >> _U(29)
    return text, pos, h[place], mix(c)


def anchors(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """Arrays by anchor: text, place in it, hash of the anchor and hash of its context."""
    sizes = np.asarray([len(r) for r in raws], np.int64)
    out, held, count = [], [], 0
    with np.errstate(over="ignore"):
        for piece in _pieces(raws):
            held.append(piece)
            count += len(piece[1]) + _PAD
            if count >= _CHUNK:
                out.append(_scan(held, sizes))
                held, count = [], 0
        if held:
            out.append(_scan(held, sizes))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def key_of(anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    """One signed value for an anchor with its context, from 48 bits of each."""
    with np.errstate(over="ignore"):
        return mix((anchor >> _U(16)) * _A ^ mix((context >> _U(16)) + _B)).view(np.int64)
