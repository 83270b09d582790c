"""Content-defined anchors: every window of a text belongs to exactly one, chosen by the window's bytes alone."""

from __future__ import annotations

import numpy as np

GRAM = 32
#: Bytes of the longest text whose tables a worker keeps.
KEPT = 1 << 20
_RNG = np.random.default_rng(20)
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse; those of texts of up to ``KEPT`` bytes are kept."""
    if n > KEPT:
        return _made(n, base)
    if base not in _powers or len(_powers[base][0]) <= n:
        _powers[base] = _made(min(max(1 << 16, 2 * n), KEPT), base)
    return _powers[base]


def _made(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    both = (_BASES[base], pow(_BASES[base], -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in both)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any substring of a text from one pass of prefix sums."""

    def __init__(self, text: bytes, base: int = 0):
        raw = np.frombuffer(text, np.uint8)
        powers, self.inverse = _tables(len(raw), base)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * powers[:len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return _mixed(h + (end - start).astype(np.uint64) * np.uint64(2 * seed + 1))


def anchors(text: bytes, width: int, sparse: int = 48) -> tuple[np.ndarray, ...]:
    """``(low, high, gram hash, context hash)`` of the anchors of a text.

    A window of ``width`` bytes belongs to its gram of ``GRAM`` bytes with the smallest hash, the first on ties. The
    windows of an anchor start at ``low`` to ``high``, one by one; its context are the bytes of all of them. Equal windows
    have equal grams at equal places. Texts shorter than ``width`` have none.
    """
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    n = len(text)
    if n < width:
        return none
    hashes = Hashes(text)
    grams = n - GRAM + 1
    every = np.arange(grams)
    h = _mixed((hashes.sums[GRAM:] - hashes.sums[:-GRAM]) * hashes.inverse[:grams])
    span = width - GRAM + 1
    # Only small hashes can win, but where a whole window has none of them.
    at = np.flatnonzero(h < np.uint64((1 << 64) // sparse))
    edges = np.concatenate([[-1], at, [grams]])
    wide = np.flatnonzero(np.diff(edges) > span)
    if len(wide):
        at = np.unique(np.concatenate([at, *[every[edges[i] + 1:edges[i + 1]] for i in wide]]))
    value, place = h[at].tolist(), at.tolist()
    left, right = [-1] * len(place), [grams] * len(place)
    stack: list[int] = []
    for i, v in enumerate(value):
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = place[i]
        if stack:
            left[i] = place[stack[-1]]
        stack.append(i)
    low = np.maximum(np.array(left) + 1, np.maximum(at - span + 1, 0))
    high = np.minimum(at, np.minimum(np.array(right) - span, n - width))
    some = low <= high
    low, high, at = low[some], high[some], at[some]
    return low, high, h[at], hashes.of(low, high + width, 1)
