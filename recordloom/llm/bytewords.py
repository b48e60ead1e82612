"""Word splitting and hashing of whole Arrow batches with numpy, without a Python loop over words.

A batch's texts stand one after another in Arrow's own UTF-8 buffer. Both word rules of this subpackage are rules
on bytes (every byte of a multi-byte character belongs to a word), so words are runs of bytes of one class, and a
word's hash is a difference of prefix sums of a polynomial modulo 2**64.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASK = (1 << 64) - 1


def _splitmix(seed: int, count: int) -> np.ndarray:
    out = np.empty(count, U64)
    state = seed & _MASK
    for i in range(count):
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out[i] = z ^ (z >> 31)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        z = x ^ (x >> U64(30))
        z = z * U64(0xBF58476D1CE4E5B9)
        z ^= z >> U64(27)
        z *= U64(0x94D049BB133111EB)
        z ^= z >> U64(31)
    return z


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words `[^\x20\x09-\x0D]+`.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_CODES = _splitmix(11, 256)
_BASE = int(_splitmix(12, 1)[0]) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(max(count, 1), U64)
    with np.errstate(over="ignore"):
        out[1:] = U64(base)
        np.multiply.accumulate(out, out=out)
    return out


class Words(NamedTuple):
    """Words of a batch. first[i]:first[i + 1] are those of text i; start and end are byte offsets into data."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(column: pa.Array, kind: np.ndarray = NOT_BLANK, hashed: bool = True) -> Words:
    """Lower-cased (A-Z only) words of every text of the column."""
    raw, offsets = buffers(column)
    data = LOWER[raw]
    inside = kind[data]
    n = len(data)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = False
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    if n:
        edge[0], edge[n] = inside[0], inside[-1]
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[inside[cuts] & inside[cuts - 1]]  # a text ends in a word and the next begins with one
    bounds = np.flatnonzero(edge)
    if len(cuts):
        bounds = np.sort(np.concatenate([bounds, cuts, cuts]))
    start, end = bounds[0::2], bounds[1::2]
    first = np.searchsorted(start, offsets)
    value = np.zeros(len(start), U64)
    if hashed and len(start):
        # Blocks keep the arrays of powers small; a word longer than a block is hashed by itself.
        with np.errstate(over="ignore"):
            step = 1 << 20
            at = 0
            while at < len(start):
                lo = start[at]
                to = max(at + 1, int(np.searchsorted(end, lo + step, side="right")))
                piece = data[lo : end[to - 1]]
                sums = np.zeros(len(piece) + 1, U64)
                np.cumsum(_CODES[piece] * _powers(_BASE, len(piece)), out=sums[1:])
                s, e = start[at:to] - lo, end[at:to] - lo
                value[at:to] = (sums[e] - sums[s]) * _powers(_BASE_INV, len(piece))[s]
                at = to
            value = mix(value ^ (end - start).astype(U64))
    return Words(data, start, end, value, first)


def gram_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word grams in order, and the first gram of each text; a shorter text is one gram, no words none."""
    counts = np.diff(words.first)
    grams = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(grams, out=first[1:])
    out = np.zeros(first[-1], U64)
    factors = _splitmix(13, k) | U64(1)
    with np.errstate(over="ignore"):
        n = len(words.hash)
        if n >= k:
            rolled = np.zeros(n - k + 1, U64)
            for j in range(k):
                rolled += words.hash[j : n - k + 1 + j] * factors[j]
            owner = np.repeat(np.arange(len(counts)), np.where(counts >= k, grams, 0))
            at = np.arange(len(owner)) - np.repeat(np.cumsum(np.where(counts >= k, grams, 0)) - np.where(counts >= k, grams, 0), np.where(counts >= k, grams, 0))
            out[first[owner] + at] = rolled[words.first[owner] + at]
        for i in np.flatnonzero((counts > 0) & (counts < k)):
            h = words.hash[words.first[i] : words.first[i + 1]]
            out[first[i]] = (h * factors[: len(h)]).sum(dtype=U64) ^ U64(len(h))
    return mix(out), first
