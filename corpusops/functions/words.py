"""Vectorised hashing of words and word windows over whole Arrow batches.

Texts are word keys: words joined by single blanks. A batch is treated as one byte array, so no Python call is made per
row or word. Hashes are 64-bit polynomials of random byte values, finalised by an avalanche step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
WINDOW = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            with np.errstate(over="ignore"):
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array without nulls, and its n+1 offsets."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span; values are 64-bit symbol codes."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(_BASE, len(values)), out=total[1:])
        return mix((total[ends] - total[starts]) * powers(_INV, len(values) + 1)[starts])


def word_hashes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a batch of keys, and n+1 offsets of the texts into it."""
    raw, off = utf8(keys)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = raw != 32
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = inside[:-1]
    heads = off[:-1][off[:-1] < len(raw)]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    tails = off[1:][off[1:] > 0] - 1
    after[tails] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return span_hashes(_BYTE[raw], starts, ends), np.searchsorted(starts, off)


def windows(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from every position, and whether that window stays within its text."""
    size = len(hashes)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(n, size)):
            out[: size - j] += hashes[j:] * WINDOW[j % len(WINDOW)] * np.uint64(2 * (j // len(WINDOW)) + 1)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(size)
    return mix(out), left >= n


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(sorted_keys)]])


def positions_in_runs(starts: np.ndarray, ends: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """All indices of the given runs, one run after another."""
    sizes = ends - starts
    total = int(sizes.sum()) if len(sizes) else 0
    if not total:
        return np.zeros(0, kind)
    out = np.repeat((starts - np.concatenate([[0], np.cumsum(sizes)[:-1]])).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


def multiset_overlap(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words shared by each pair of keys, counted with repeats, and the word counts of both sides."""
    a, ao = word_hashes(left)
    b, bo = word_hashes(right)
    n, na, nb = len(left), np.diff(ao), np.diff(bo)
    row = np.concatenate([np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)])
    word = np.concatenate([a, b])
    side = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
    order = np.lexsort((word, row))
    row, word, side = row[order], word[order], side[order]
    if not len(row):
        return np.zeros(n, np.int64), na, nb
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])])
    heads = np.flatnonzero(new)
    total = np.diff(np.concatenate([heads, [len(row)]]))
    right_n = np.add.reduceat(side.astype(np.int64), heads)
    shared = np.zeros(n, np.int64)
    np.add.at(shared, row[heads], np.minimum(right_n, total - right_n))
    return shared, na, nb
