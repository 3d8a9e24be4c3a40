"""Numpy kernels over packed texts: word bounds, hashes of words and of byte runs."""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse modulo 2**64, for prefix sums that give any run's hash.
BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n at least, kept between calls."""
    if not _powers or len(_powers[0][0]) <= n:
        size = max(1 << 12, 1 << int(n + 1).bit_length())
        up = np.full(size, BASE, np.uint64)
        up[0] = 1
        down = np.full(size, _U(_inverse(int(BASE))), np.uint64)
        down[0] = 1
        _powers[:] = [(np.multiply.accumulate(up), np.multiply.accumulate(down))]
    return _powers[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_values(seed: int) -> np.ndarray:
    """One random-looking 64-bit value for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95) + _U(seed))


_VALUES = byte_values(7)


def prefix_sums(data: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[data[k]] * BASE**k for i <= k < j, modulo 2**64."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: equal runs have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spaces(data: np.ndarray) -> np.ndarray:
    """Where 0x20 and 0x09-0x0D stand."""
    return _SPACE[data]


def space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the maximal runs without 0x20 and 0x09-0x0D; none crosses texts."""
    return _runs(~_SPACE[data], offsets)


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, byte by byte."""
    return _LOWER[data]


def shingles(hashes: np.ndarray, docs: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of ``width`` words; a shorter text is one shingle of all its words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(docs, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(counts)])
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        part = np.zeros(n, np.uint64)
        part[: n - k] = hashes[k:]
        rolled = rolled * _U(0xC2B2AE3D27D4EB4F) + mix(part + _U(k + 1))
    index = np.arange(n)
    whole = index + width <= first[docs + 1]
    short = np.flatnonzero((counts > 0) & (counts < width))
    extra = np.zeros(len(short), np.uint64)
    for k in range(width - 1):
        has = counts[short] > k
        at = np.minimum(first[short] + k, n - 1)
        extra = np.where(has, extra * _U(0xC2B2AE3D27D4EB4F) + mix(hashes[at] + _U(k + 101)), extra)
    return mix(np.concatenate([rolled[whole], extra])), np.concatenate([docs[whole], short])


def distinct_per_doc(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, value) pairs, in order of document and value."""
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    if len(values):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])])
        values, docs = values[new], docs[new]
    return values, docs


def sums_per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of ``values`` between each pair of neighbouring offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
