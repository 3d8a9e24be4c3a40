"""Masks as run lengths: areas, overlaps, boxes, connected parts, cleaning.

A mask is the uncompressed run-length string of its pixels column by column: blank-separated counts
that begin with the background. Work on pixels is numpy inside Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode(rle: str, h: int, w: int) -> np.ndarray:
    counts = np.array(rle.split(), np.int64)
    flat = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
    out = np.zeros(h * w, bool)
    out[: len(flat)] = flat[: h * w]
    return out.reshape(w, h).T


def encode(mask: np.ndarray) -> str:
    flat = np.asarray(mask, bool).T.ravel()
    edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    counts = np.diff(np.concatenate([[0], edges, [len(flat)]]))
    return " ".join(map(str, ([0] if len(flat) and flat[0] else []) + counts.tolist()))


def runs(rle: Column) -> Column:
    """Foreground runs as array<struct<begin, end>> of flat pixel numbers, without any decoding."""
    counts = F.transform(F.split(rle, " "), lambda c: c.cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin: bigint, end: bigint>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        n = F.element_at(counts, i + 1)
        here = F.array(F.struct(acc["at"].alias("begin"), (acc["at"] + n).alias("end")))
        return F.struct((acc["at"] + n).alias("at"), F.when((i % 2 == 1) & (n > 0), F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(counts) - 1), start, step, lambda acc: acc["out"])


def area(rle: Column) -> Column:
    """Pixels of a mask: the sum of every second count."""
    odd = F.filter(F.split(rle, " "), lambda c, i: i % 2 == 1)
    return F.aggregate(odd, F.lit(0).cast("long"), lambda s, c: s + c.cast("long"))


def spans(rle: str, pixels: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last pixel of each foreground run, cut at ``pixels``."""
    ends = np.cumsum(np.array(rle.split(), np.int64))
    begins, ends = ends[:-1:2], ends[1::2]
    if pixels is not None:
        begins, ends = np.minimum(begins, pixels), np.minimum(ends, pixels)
    some = ends > begins
    return begins[some], ends[some]


def _before(b: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """How much of the sorted intervals b lies before each pixel."""
    sums = np.concatenate([[0], np.cumsum(b[1] - b[0])])
    k = np.searchsorted(b[0], x, side="right")
    last = np.maximum(k - 1, 0)
    return np.where(k > 0, sums[last] + np.minimum(x, b[1][last]) - b[0][last], 0)


def common_pixels(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Pixels in runs of both: for each end of a run of a, how much of b lies before it."""
    if not len(a[0]) or not len(b[0]):
        return 0
    return int((_before(b, a[1]) - _before(b, a[0])).sum())


# Many masks at once: the pixels of mask k are numbered from k * stride, so intervals of different masks never touch


def run_table(rles: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask, first, one past last pixel) of the foreground runs of many masks that are not empty; null masks have none."""
    texts = [x if x is not None else "" for x in rles]
    lens = np.fromiter((len(x.split()) for x in texts), np.int64, len(texts))
    joined = " ".join(texts)
    counts = np.array(joined.split(), np.int64) if joined.strip() else np.zeros(0, np.int64)
    sums, firsts = np.cumsum(counts), np.cumsum(lens) - lens
    row = np.repeat(np.arange(len(texts)), lens)
    own = np.concatenate([[0], sums])[firsts]
    odd = (np.arange(len(counts)) - firsts[row]) % 2 == 1
    row, ends, counts = row[odd], (sums - own[row])[odd], counts[odd]
    some = counts > 0
    return row[some], (ends - counts)[some], ends[some]


def _many_spans(rles: list, pixels: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """``spans`` of many masks, cut at their ``pixels``."""
    row, begins, ends = run_table(rles)
    begins, ends = np.minimum(begins, pixels[row]), np.minimum(ends, pixels[row])
    some = ends > begins
    base = row[some] * stride
    return begins[some] + base, ends[some] + base


def _summed(begins: np.ndarray, sizes: np.ndarray, stride: int, n: int) -> np.ndarray:
    """Sizes of intervals by mask: whole numbers below 2**53, so exact."""
    return np.bincount(begins // stride, weights=sizes, minlength=n)


def _many_common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], stride: int, n: int) -> np.ndarray:
    """``common_pixels`` of each mask."""
    if not len(a[0]) or not len(b[0]):
        return np.zeros(n)
    return _summed(a[0], _before(b, a[1]) - _before(b, a[0]), stride, n)


#: Characters of masks, columns and their copies in growing, that numpy works on at once.
WORK = 1 << 21


def pair_overlaps(table: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of pairs of the n masks of a ``run_table``, given by their numbers: a mask is cut into runs once, however many pairs it is in.

    Only pairs whose first and last pixels enclose a common one are compared; two empty masks give 0.
    """
    row, begins, ends = table
    runs, sizes = np.bincount(row, minlength=n), np.bincount(row, weights=ends - begins, minlength=n)
    last = np.cumsum(runs)
    first = last - runs
    out = np.zeros(len(a))
    met = np.flatnonzero((runs[a] > 0) & (runs[b] > 0))
    met = met[(begins[first[a[met]]] < ends[last[b[met]] - 1]) & (begins[first[b[met]]] < ends[last[a[met]] - 1])]
    if not len(met):
        return out
    stride = int(ends.max()) + 1

    def laid(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.repeat(np.arange(len(side)), runs[side])
        at = first[side][k] + np.arange(len(k)) - (np.cumsum(runs[side]) - runs[side])[k]
        return begins[at] + k * stride, ends[at] + k * stride

    slices = np.cumsum(runs[a[met]] + runs[b[met]]) // WORK
    for k in np.split(met, np.flatnonzero(np.diff(slices)) + 1):
        common = _many_common(laid(a[k]), laid(b[k]), stride, len(k))
        out[k] = common / (sizes[a[k]] + sizes[b[k]] - common)
    return out


def _in_slices(one: Callable[..., np.ndarray], a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series, copies: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``one`` over slices of a batch that are about ``WORK`` large; a larger pair of masks makes a slice of its own."""
    x, y, h, w = list(a), list(b), h.to_numpy(np.int64), w.to_numpy(np.int64)
    chars = np.fromiter(((len(p) if p is not None else 0) + (len(q) if q is not None else 0) for p, q in zip(x, y, strict=True)), np.int64, len(x))
    slices = np.cumsum((chars + w) * copies(h, w)) // WORK
    out = np.zeros(len(x))
    for k in np.split(np.arange(len(x)), np.flatnonzero(np.diff(slices)) + 1):
        if len(k):
            out[k] = one(x[k[0] : k[-1] + 1], y[k[0] : k[-1] + 1], h[k], w[k])
    return out


def _overlaps(a: list, b: list, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    pixels, n = h * w, len(a)
    stride = int(pixels.max()) + 1
    p, q = _many_spans(a, pixels, stride), _many_spans(b, pixels, stride)
    common = _many_common(p, q, stride, n)
    union = _summed(p[0], p[1] - p[0], stride, n) + _summed(q[0], q[1] - q[0], stride, n) - common
    found = np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)
    return np.where([x is None or y is None for x, y in zip(a, b, strict=True)], np.nan, found)


@F.pandas_udf(T.DoubleType())
def mask_iou(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """Intersection over union from run lengths; two empty masks give 0, a null mask null."""
    return pd.Series(_in_slices(_overlaps, a, b, h, w, lambda h, w: np.ones_like(h)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def box_of_mask(rle: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """First and last true row and column as ltrb, from run lengths; an empty mask gives null."""

    def one(x: str, m: int, n: int):
        begins, ends = spans(x, m * n) if x is not None else (np.zeros(0, int),) * 2
        if not len(begins):
            return None
        ends = ends - 1
        several = (begins // m != ends // m).any()  # a run over the end of a column holds a last and a first row
        rows = (0, m - 1) if several else ((begins % m).min(), (ends % m).max())
        return [float(begins[0] // m), float(rows[0]), float(ends[-1] // m), float(rows[1])]

    return pd.Series([one(x, int(m), int(n)) for x, m, n in zip(rle, h, w, strict=True)])


def column_runs(rle: str, h: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, first row, one past last row) of each run, runs over the end of a column cut there."""
    return _columns(*spans(rle, h * w), h)[:3]


def pieces(rle: str, h: int, w: int, corners: bool = True) -> list[int]:
    """Sizes of connected parts, largest first; runs of neighbouring columns that touch are one part, at corners too if asked."""
    column, top, end = column_runs(rle, h, w)
    parent = list(range(len(column)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    reach = 1 if corners else 0
    first = np.searchsorted(column, np.arange(w + 1))
    for c in range(1, w):
        i, j = first[c - 1], first[c]
        while i < first[c] and j < first[c + 1]:
            if top[i] < end[j] + reach and top[j] < end[i] + reach:
                parent[root(i)] = root(j)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    sizes: dict[int, int] = {}
    for k in range(len(column)):
        sizes[root(k)] = sizes.get(root(k), 0) + int(end[k] - top[k])
    return sorted(sizes.values(), reverse=True)


@F.pandas_udf(T.ArrayType(T.LongType()))
def piece_sizes(rle: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """Sizes of the 8-connected parts of each mask, largest first."""
    return pd.Series([None if x is None else pieces(x, int(m), int(n)) for x, m, n in zip(rle, h, w, strict=True)])


def _disc(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic kernel of odd ``size``: in each row as far as the rounded ellipse reaches."""
    r = size // 2
    reach = [round(r * float(np.sqrt(max(r * r - d * d, 0))) / r) if r else 0 for d in range(-r, r + 1)]
    return [(y - r, x) for y, n in enumerate(reach) for x in range(-n, n + 1)]


def cleaned(mask: np.ndarray, size: int = 5) -> np.ndarray:
    """Opening, then closing by an elliptic kernel; beyond the image nothing is worn away and nothing grows in."""
    r, kernel = size // 2, _disc(size)
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    out = np.zeros_like(mask)
    if not len(rows):
        return out
    part = (slice(max(rows[0] - 2 * size, 0), rows[-1] + 2 * size + 1), slice(max(columns[0] - 2 * size, 0), columns[-1] + 2 * size + 1))

    def swept(m: np.ndarray, grow: bool) -> np.ndarray:
        p = np.pad(m, r, constant_values=not grow)
        found = np.full(m.shape, not grow)
        for y, x in kernel:
            shifted = p[r + y : r + y + m.shape[0], r + x : r + x + m.shape[1]]
            found = found | shifted if grow else found & shifted
        return found

    small = mask[part]
    for grow in (False, True, True, False):
        small = swept(small, grow)
    out[part] = small
    return out


def component_sizes(mask: np.ndarray) -> list[int]:
    """Sizes of 4-connected components, largest first."""
    left, sizes = np.array(mask, bool), []
    for r, c in np.argwhere(left):
        if not left[r, c]:
            continue
        left[r, c] = False
        todo, n = [(r, c)], 0
        while todo:
            y, x = todo.pop()
            n += 1
            for v, u in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= v < left.shape[0] and 0 <= u < left.shape[1] and left[v, u]:
                    left[v, u] = False
                    todo.append((v, u))
        sizes.append(n)
    return sorted(sizes, reverse=True)


# Sets of pixels as sorted intervals of flat pixel numbers, column by column


def _where(begins: np.ndarray, ends: np.ndarray, full: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where at least one interval lies, and fewer than ``full`` of them."""
    some = ends > begins
    at, place = np.unique(np.concatenate([begins[some], ends[some]]), return_inverse=True)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = int(some.sum())
    count = np.cumsum(np.bincount(place, weights=np.repeat([1, -1], n), minlength=len(at))).astype(np.int64)
    inside = (count > 0) & (count < full) if full else count > 0
    turns = np.diff(inside.astype(np.int8), prepend=0)
    return at[turns == 1], at[turns == -1]


def _columns(begins: np.ndarray, ends: np.ndarray, h: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(column, first row, one past last row, number of the interval) of each interval, cut where columns end; ``h`` for all or for each."""
    parts = (ends - 1) // h - begins // h + 1
    run = np.repeat(np.arange(len(begins)), parts)
    h = h[run] if isinstance(h, np.ndarray) else h
    column = begins[run] // h + np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
    return column, np.maximum(begins[run], column * h) - column * h, np.minimum(ends[run], (column + 1) * h) - column * h, run


def _sized(intervals: tuple[np.ndarray, np.ndarray]) -> int:
    return int((intervals[1] - intervals[0]).sum())


def _placed(intervals: tuple[np.ndarray, np.ndarray], h: np.ndarray, stride: int) -> tuple[np.ndarray, ...]:
    """(mask, column, first row, one past last row) of the intervals of many masks."""
    mask = intervals[0] // stride
    column, top, end, run = _columns(intervals[0] - mask * stride, intervals[1] - mask * stride, h[mask])
    return mask[run], column, top, end


def _many_boundaries(spans_: tuple[np.ndarray, np.ndarray], h: np.ndarray, w: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """``boundary`` of many masks from their runs."""
    mask, column, top, end = _placed(spans_, h, stride)
    # the mask and its three neighbours, each moved to the pixel that looks at it
    base, tall, inner_end, inner_column = mask * stride, h[mask], h[mask] - 1, w[mask] - 1
    begins, ends = [], []
    for right, down in ((0, 0), (0, 1), (1, 0), (1, 1)):
        c, a, b = column - right, np.maximum(top - down, 0), np.minimum(end - down, inner_end)
        here = (c >= 0) & (c < inner_column) & (b > a)
        begins.append((base + c * tall + a)[here])
        ends.append((base + c * tall + b)[here])
    found = [_where(np.concatenate(begins), np.concatenate(ends), 4)]
    last = column == inner_column
    at = np.tile((base + inner_column * tall)[last], 2)
    sides = np.concatenate([np.maximum(top[last] - down, 0) for down in (0, 1)]), np.concatenate([np.minimum(end[last] - down, inner_end[last]) for down in (0, 1)])
    found.append(_where(at + sides[0], at + np.maximum(sides[1], sides[0]), 2))
    wide = int(w.max(initial=0)) + 1
    low = (end == tall) & (tall > 0)
    key, bottom = (mask * wide + column)[low], column[low]
    row = np.setxor1d(key[bottom < inner_column[low]], key[bottom > 0] - 1)
    row = row // wide * stride + row % wide * h[row // wide] + h[row // wide] - 1
    found.append((row, row + 1))
    return _where(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def boundary(rle: str, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels that differ from the next one to the right, below, or both, as intervals; the mask is never decoded.

    In the last row only the right neighbour counts, in the last column only the one below, and the last pixel never.
    """
    return _many_boundaries(spans(rle, h * w), np.array([h]), np.array([w]), h * w + 1)


def _many_grown(intervals: tuple[np.ndarray, np.ndarray], reach: np.ndarray, h: np.ndarray, w: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """``grown`` of the intervals of many masks, each by its own reach."""
    mask, column, top, end = _placed(intervals, h, stride)
    base, tall, wide, far = mask * stride, h[mask], w[mask], reach[mask]
    begins, ends = [], []
    most = int(reach.max(initial=0))
    for aside in range(-most, most + 1):
        here = (column + aside >= 0) & (column + aside < wide) & (far >= abs(aside))
        more = np.sqrt(far[here] * far[here] - aside * aside).astype(np.int64)
        at = base[here] + (column[here] + aside) * tall[here]
        begins.append(at + np.maximum(top[here] - more, 0))
        ends.append(at + np.minimum(end[here] + more, tall[here]))
    return _where(np.concatenate(begins), np.concatenate(ends))


def grown(intervals: tuple[np.ndarray, np.ndarray], reach: int, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """All pixels within ``reach`` of a set: each column's intervals widened in the columns beside it, less the farther away."""
    return _many_grown(intervals, np.array([reach]), np.array([h]), np.array([w]), h * w + 1)


def reach_of(h: int, w: int, share: float = 0.008) -> int:
    """Pixels within which boundaries agree: a share of the diagonal, rounded up."""
    return int(np.ceil(share * np.hypot(h, w)))


def _reaches(h: np.ndarray, w: np.ndarray, share: float = 0.008) -> np.ndarray:
    return np.ceil(share * np.hypot(h, w)).astype(np.int64)


def boundary_f(a: str | None, b: str | None, h: int, w: int, reach: int | None = None) -> float:
    """F of the boundary pixels of two masks that lie within ``reach`` of the other's; a null mask is empty, two empty ones give 1."""
    p, q = (boundary(m, h, w) if m is not None else (np.zeros(0, np.int64),) * 2 for m in (a, b))
    n, m = _sized(p), _sized(q)
    if not n or not m:
        return 1.0 if n == m else 0.0
    r = reach_of(h, w) if reach is None else reach
    precision, recall = common_pixels(p, grown(q, r, h, w)) / n, common_pixels(q, grown(p, r, h, w)) / m
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def _boundary_scores(a: list, b: list, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``boundary_f`` of many pairs of masks."""
    pixels, n = h * w, len(a)
    stride = int(pixels.max()) + 1
    reach = _reaches(h, w)
    p, q = (_many_boundaries(_many_spans(x, pixels, stride), h, w, stride) for x in (a, b))
    x, y = (_summed(v[0], v[1] - v[0], stride, n) for v in (p, q))
    precision = _many_common(p, _many_grown(q, reach, h, w, stride), stride, n) / np.maximum(x, 1)
    recall = _many_common(q, _many_grown(p, reach, h, w, stride), stride, n) / np.maximum(y, 1)
    both = precision + recall
    f = np.where(both > 0, 2 * precision * recall / np.where(both > 0, both, 1), 0.0)
    return np.where((x == 0) | (y == 0), (x == y).astype(float), f)


@F.pandas_udf(T.DoubleType())
def boundary_score(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """``boundary_f`` of two columns of masks, whole batches of pairs at once."""
    return pd.Series(_in_slices(_boundary_scores, a, b, h, w, lambda h, w: 2 * _reaches(h, w) + 1))
