"""Suffix arrays and common prefixes in numpy, for one shard of text at a time."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, symbol_bits: int, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(order, rank)`` of the suffixes of an array of symbols below ``2**symbol_bits``, by Larsson-Sadakane refinement.

    Suffixes are sorted by their first few symbols. Then, in rounds, only groups that are still tied are sorted by the
    rank of the suffix ``h`` places on, which doubles the depth each time. The end of the text sorts before any symbol.
    With ``depth``, rounds stop when ties agree on that many symbols; tied suffixes then share a rank.
    """
    n = len(text)
    bits = max(1, int(n).bit_length())
    if 3 * bits > 63:
        raise ValueError("a shard holds at most 2**21 - 1 symbols")
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = max(1, (63 - bits) // (symbol_bits + 1))
    key = np.zeros(n, np.int64)
    wide = np.concatenate([text.astype(np.int64) + 1, np.zeros(h, np.int64)])
    for i in range(h):
        key = (key << (symbol_bits + 1)) | wide[i:i + n]
    mask = (1 << bits) - 1
    # Sorting key and place in one number is several times faster than sorting places by key.
    packed = np.sort((key << bits) | np.arange(n))
    order = packed & mask
    packed >>= bits
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    del packed, key, wide
    sizes = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, sizes)
    open_at = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    while len(open_at) and (depth is None or h < depth):
        place = order[open_at]
        after = place + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        packed = np.sort((rank[place] << (2 * bits)) | (second << bits) | place)
        place = packed & mask
        packed >>= bits
        order[open_at] = place
        new = np.concatenate([[True], packed[1:] != packed[:-1]])
        head = np.maximum.accumulate(np.where(new, open_at, 0))
        rank[place] = head
        ends = np.append(np.flatnonzero(new), len(new))
        sizes = np.diff(ends)
        open_at = open_at[np.repeat(sizes, sizes) > 1]
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Length of the prefix that each suffix, by place in the text, shares with the one before it in order.

    Kasai's rule: one place on, the length falls by one at most. It falls by exactly one where both suffixes follow equal
    symbols, so only the other places are compared, eight symbols at a time; a running maximum gives the rest.
    ``rank`` must be without ties. The last symbol must occur once.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    same = np.zeros(n, bool)
    inner = (at > 0) & (before > 0)
    same[inner] = text[at[inner] - 1] == text[before[inner] - 1]
    start = np.flatnonzero(~same & (before >= 0))
    length = np.zeros(n, np.int64)
    left, right, live = start.copy(), before[start], start.copy()
    step = 8
    padded = np.concatenate([text, np.zeros(1 << 16, text.dtype)])
    while len(live):
        offsets = np.arange(step)
        equal = padded[np.minimum(left[:, None] + offsets, n)] == padded[np.minimum(right[:, None] + offsets, n)]
        equal &= (np.maximum(left, right)[:, None] + offsets) < n
        run = np.where(equal.all(1), step, np.argmin(equal, 1))
        length[live] += run
        more = run == step
        left, right, live = left[more] + step, right[more] + step, live[more]
        # Few pairs are left after the first steps; they are compared in longer ones.
        step = min(1 << 14, max(8, (1 << 18) // max(1, len(live))))
    shown = np.where(~same & (before >= 0), length + at, 0)
    return np.where(before >= 0, np.maximum.accumulate(shown) - at, 0).clip(0)
