"""Shingles of lines, their MinHash bands, parities and exact Jaccard similarities, for many lines at a time.

A shingle is five characters in a row; a shorter line is one shingle.  Lines lie one after the
other in one array of code points, so a step works on all of their shingles at once.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Bins of the one-permutation MinHash; bands, and bins in each.
BINS, BANDS, ROWS = 64, 10, 6
#: Words of 64 bits in the parities of a line.
WORDS = 16
#: Characters that are worked on at a time (a longer line is one such part).
STEP_CHARS = 1 << 19
#: No code point: fills short lines up to a shingle.
NONE = 0x110000
EMPTY = np.uint32(0xFFFFFFFF)
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: For each bin, the order in which the others are asked if it is empty.
_PROBES = np.array([np.random.default_rng(1000 + b).permutation(BINS) for b in range(BINS)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def parts(lines: list[str]) -> list[tuple[int, int]]:
    """Ranges of lines of about STEP_CHARS characters together."""
    out, first, size = [], 0, 0
    for i, x in enumerate(lines):
        if size and size + len(x) > STEP_CHARS:
            out.append((first, i))
            first, size = i, 0
        size += len(x)
    return [*out, (first, len(lines))] if lines else []


def windows(lines: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(line, characters): the line of every shingle, and its five code points."""
    sizes = np.array([len(x) for x in lines], np.int64)
    text = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
    short = np.flatnonzero(sizes < SHINGLE)
    if len(short):
        fill = np.repeat(np.cumsum(sizes)[short], SHINGLE - sizes[short])
        text = np.insert(text, fill, NONE)
        sizes = np.maximum(sizes, SHINGLE)
    line = np.repeat(np.arange(len(sizes)), sizes)
    start = np.ones(len(text), bool)
    ends = np.cumsum(sizes)
    for k in range(1, SHINGLE):
        start[ends - k] = False
    at = np.flatnonzero(start)
    return line[at], [text[at + k] for k in range(SHINGLE)]


def bands(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) hashes; two lines that agree in one are a candidate pair."""
    return np.concatenate([_bands(lines[a:b]) for a, b in parts(lines)]) if lines else np.zeros((0, BANDS), np.int64)


def _hashed(lines: list[str], bits: int) -> np.ndarray:
    """The line of every shingle and the upper ``bits`` bits of its hash, in one number, sorted."""
    line, chars = windows(lines)
    h = chars[0].astype(np.uint64)
    for c in chars[1:]:
        h = h * _GOLDEN + c
    return np.sort((line.astype(np.uint64) << np.uint64(bits)) | (mixed(h) >> np.uint64(64 - bits)))


def parities(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, words): how many shingles each line has, and for each of WORDS * 64 classes of shingles whether it has
    an odd number of them.  Two lines have at least as many shingles that only one of them has as they have different
    bits.  Shingles of a line are told apart by 44 bits, so a size can be too small by one, hardly ever by more."""
    sizes, words = np.zeros(len(lines), np.int64), np.zeros((len(lines), WORDS), np.uint64)
    for a, b in parts(lines):
        key = _hashed(lines[a:b], 44)
        key = key[np.r_[True, key[1:] != key[:-1]]]
        sizes[a:b] = np.bincount((key >> np.uint64(44)).astype(np.int64), minlength=b - a)
        # a word is told by the upper four bits of a hash, so that its shingles lie together, a bit by the lower six
        cell = key >> np.uint64(40)
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        words[a:b].reshape(-1)[cell[first].astype(np.int64)] = np.bitwise_xor.reduceat(np.uint64(1) << (key & np.uint64(63)), first)
    return sizes, words.view(np.int64)


def _bands(lines: list[str]) -> np.ndarray:
    key = _hashed(lines, 32)
    # the first of each (line, bin): bins are the upper six bits of a hash
    cell = key >> np.uint64(26)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(key) else np.zeros(0, np.int64)
    least = np.full(len(lines) * BINS, EMPTY, np.uint32)
    least[cell[first].astype(np.int64)] = (key[first] & np.uint64((1 << 26) - 1)).astype(np.uint32)
    least = least.reshape(-1, BINS)
    full = least.copy()
    for b in range(BINS):
        left = np.flatnonzero(least[:, b] == EMPTY)
        for p in _PROBES[b]:
            if not len(left):
                break
            full[left, b] = least[left, p]
            left = left[least[left, p] == EMPTY]
    out = np.empty((len(lines), BANDS), np.uint64)
    for k in range(BANDS):
        h = np.full(len(lines), np.uint64(k + 1)) * _MIX1
        for b in range(k * ROWS, (k + 1) * ROWS):
            h = mixed(h * _GOLDEN + full[:, b])
        out[:, k] = h
    return out.view(np.int64)


def shingles(line: str) -> set[str]:
    """All shingles of a line."""
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)} or {line}


def jaccard(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(shared, together): sizes of the intersection and of the union of the shingle sets of each pair, exact;
    a line's set is made once."""
    sets: dict[str, set[str]] = {}
    shared, together = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for i, pair in enumerate(zip(a, b, strict=True)):
        for x in pair:
            if x not in sets:
                sets[x] = shingles(x)
        u, v = (sets[x] for x in pair)
        shared[i] = len(u & v)
        together[i] = len(u) + len(v) - shared[i]
    return shared, together


__all__ = ["BANDS", "WORDS", "bands", "jaccard", "parities", "shingles", "windows"]
