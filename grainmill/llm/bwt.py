"""Suffix array, Burrows-Wheeler transform and threshold-bounded interval expansion, vectorised with numpy.

shared_windows() finds the strings of `length` bytes that several segments have. Segments are laid end to end with separators that differ
from each other. Intervals of the suffix array are extended backward through the transform, breadth first (Beller, Gog, Ohlebusch and
Schnattinger, 2013): in round l those boundaries get known whose neighbours have a common prefix of exactly l. The search stops after
round length - 1; where no boundary is known by then, neighbours share at least `length` bytes.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling until all ranks differ; the text has to end with a symbol that occurs once."""
    n = len(text)
    # the first ranks are of several symbols together, in one word
    bits = int(text.max()).bit_length() + 1
    k = max(1, 62 // bits)
    rank = np.zeros(n, np.int64)
    for i in range(k):
        rank <<= bits
        rank[: n - i] |= text[i:] + 1
    while True:
        sa = np.argsort(rank)
        ordered = rank[sa]
        dense = np.empty(n, np.int64)
        dense[sa] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = dense
        if rank[sa[-1]] == n - 1:
            return sa
        if k >= n:
            raise ValueError("the text has to end with a symbol that occurs once")
        follow = np.zeros(n, np.int64)
        follow[: n - k] = rank[k:] + 1
        rank = rank * (int(rank.max()) + 2) + follow
        k *= 2


def boundaries(text: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """n + 1 flags; flag i: suffixes sa[i-1] and sa[i] share fewer than `length` symbols."""
    n = len(text)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    before = place[sa - 1]  # of the suffix one symbol longer; sa - 1 wraps at the text's start
    symbol = text[sa - 1]
    known = np.zeros(n + 1, bool)
    first = np.concatenate([[0], np.flatnonzero(np.diff(text[sa])) + 1])
    known[first] = True
    known[n] = True
    low, high = first, np.append(first[1:], n)
    for _ in range(1, length):
        one = high - low == 1
        a = before[low[one]]
        lo, hi = low[~one], high[~one]
        size = hi - lo
        owner = np.repeat(np.arange(len(lo)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        to, c = before[at], symbol[at]
        order = np.argsort(owner * n + to)
        to, owner, c = to[order], owner[order], c[order]
        if len(to):
            start = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (c[1:] != c[:-1])]))
            stop = np.append(start[1:], len(to)) - 1
            low, high = np.concatenate([a, to[start]]), np.concatenate([a + 1, to[stop] + 1])
        else:
            low, high = a, a + 1
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
        if not len(low):
            break
    return known


def shared_windows(segments: list[bytes], owner: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """[(segment, first, end)]: windows of `length` bytes starting at first .. end-1 occur in a segment of a smaller owner too."""
    sizes = np.array([len(s) for s in segments], np.int64)
    n = int(sizes.sum()) + len(segments)
    text = np.empty(n, np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    separator = starts + sizes
    inside = np.ones(n, bool)
    inside[separator] = False
    text[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + len(segments)
    text[separator] = np.arange(len(segments))
    sa = suffix_array(text)
    known = boundaries(text, sa, length)
    owners = np.repeat(owner, sizes + 1)
    group = np.flatnonzero(known[:n])
    least = np.minimum.reduceat(owners[sa], group)
    smaller = np.empty(n, bool)
    smaller[sa] = np.repeat(least, np.diff(np.append(group, n))) < owners[sa]
    turn = np.diff(np.concatenate([[False], smaller, [False]]).astype(np.int8))
    lo, hi = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    seg = np.searchsorted(starts, lo, side="right") - 1
    return [(int(s), int(a - starts[s]), int(b - starts[s])) for s, a, b in zip(seg, lo, hi, strict=True)]
