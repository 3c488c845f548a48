"""Vectorised hashes of words and byte spans: polynomial prefix sums modulo 2^64 over random byte values."""

from __future__ import annotations

import hashlib

import numpy as np

_rng = np.random.default_rng(20240607)
VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A second, independent table: hashes by both together have 128 bits.
OTHER_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Longer words than this are hashed by BLAKE2: long words of two letters can be built that collide in any polynomial modulo 2^64.
LONG = 256
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {False: np.ones(1, np.uint64), True: np.ones(1, np.uint64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to the powers 0 .. n-1."""
    p = _powers[inverse]
    while len(p) < n:
        step = p[-1:] * (INVERSE if inverse else BASE)
        p = np.concatenate([p, p * step[0]])
    _powers[inverse] = p if len(p) <= 1 << 23 else _powers[inverse]
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix(data: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end]; equal content of equal length, equal hash."""
    inv = powers(len(sums), True)
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def word_values(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """Hash of each word data[start:end], by the table of byte values."""
    out = spans(prefix(data, values), start, end)
    for i in np.flatnonzero(end - start > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=values[:4].tobytes()).digest(), "little")
    return out


def words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of bytes that is_word (256 flags) marks."""
    flag = np.zeros(len(data) + 2, np.int8)
    flag[1:-1] = is_word[data]
    turn = np.diff(flag)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
