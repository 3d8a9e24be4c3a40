"""Quality classifier: histogram gradient-boosted trees over document statistics.

A document becomes some thirty statistics (lengths, shares of character classes, repetition of
words and lines). The trees are fitted on a bounded, documented sample of labelled rows and kept
as flat arrays; scoring walks all rows of a slice down one tree at a time with numpy indexing.

Defined results: a null or empty text has all-zero statistics and gets the score that the trees
give to them; a null doc_id counts as the text ''; an empty table gives an empty result; without
usable labels every score is 0.5; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bytes_of, sliced

#: At most so many labelled rows are used to fit.
FIT_ROWS = 20_000
_CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "space": [0x20, *range(9, 14)],
    "high": [*range(128, 256)],
    "stop": [ord(c) for c in ".,;:?'\"()-"],
    "bang": [ord("!")],
    "pipe": [ord("|")],
    "hash": [ord(c) for c in "#$%&*"],
    "other": [ord(c) for c in "<>[]{}=+/\\@^_~`"],
}
_TABLES = {name: np.isin(np.arange(256), codes) for name, codes in _CLASSES.items()}
FEATURES = [
    *(f"share_{name}" for name in _CLASSES),
    "log_bytes", "log_words", "mean_word", "long_words", "one_letter_words", "distinct_words", "most_common_word",
    "log_lines", "mean_line", "distinct_lines", "words_with_mark", "upper_words", "digit_words", "distinct_pairs",
    "bytes_entropy", "word_length_spread", "capital_starts", "repeats_in_a_row",
]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Rows kept from learning: crc32 of the id's text leaves this remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _share_distinct(values: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document and the count of its most frequent one."""
    order = np.lexsort((values, docs))
    v, d = values[order], docs[order]
    if not len(v):
        return np.zeros(n), np.zeros(n)
    new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])]))
    runs = np.diff(np.append(new, len(v)))
    most = np.zeros(n)
    np.maximum.at(most, d[new], runs)
    return np.bincount(d[new], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, from the whole text."""
    data, offsets = bytes_of(texts)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    cols = [K.sums_per_doc(_TABLES[c][data], offsets) / some for c in _CLASSES]
    starts, ends, docs = K.space_words(data, offsets)
    length = (ends - starts).astype(float)
    words = np.bincount(docs, minlength=n).astype(float)
    w1 = np.maximum(words, 1)
    per = lambda x: np.bincount(docs, weights=x, minlength=n)
    within = lambda t: (c := np.concatenate([[0], np.cumsum(t[data])]))[ends] - c[starts]
    hashes = K.run_hashes(K.prefix_sums(data), starts, ends)
    distinct, most = _share_distinct(hashes, docs, n)
    mean = per(length) / w1
    newline = data == 10
    line_ends = np.flatnonzero(newline)
    first = np.zeros(len(data) + 1, bool)
    line_starts = np.unique(np.concatenate([offsets[:-1][size > 0], line_ends + 1]))
    line_starts = line_starts[line_starts < len(data)]
    first[line_starts] = True
    bounds = np.append(line_starts, len(data))
    line_docs = np.searchsorted(offsets, line_starts, side="right") - 1
    lines = np.bincount(line_docs, minlength=n).astype(float)
    sums = K.prefix_sums(data)
    line_distinct, _ = _share_distinct(K.run_hashes(sums, line_starts, bounds[1:]), line_docs, n) if len(line_starts) else (np.zeros(n), None)
    marks = within(_TABLES["hash"] | _TABLES["pipe"] | _TABLES["bang"]) > 0
    upper = (within(_TABLES["upper"]) == length) & (length > 1)
    pair = (docs[1:] == docs[:-1]) if len(docs) else np.zeros(0, bool)
    pair_hash = (hashes[:-1] * np.uint64(31) + hashes[1:])[pair] if len(docs) else np.zeros(0, np.uint64)
    pair_docs = docs[:-1][pair] if len(docs) else docs
    pairs, _ = _share_distinct(pair_hash, pair_docs, n)
    twice = np.bincount(pair_docs, weights=(hashes[:-1] == hashes[1:])[pair], minlength=n) if len(docs) else np.zeros(n)
    code = np.repeat(np.arange(n) * 32, np.diff(offsets)) + (data >> 3)
    share = np.bincount(code, minlength=n * 32).reshape(n, 32) / some[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    capital = _TABLES["upper"][data[starts]] if len(starts) else np.zeros(0, bool)
    cols += [
        np.log1p(size), np.log1p(words), mean, per(length > 20) / w1, per(length == 1) / w1, distinct / w1, most / w1,
        np.log1p(lines), size / np.maximum(lines, 1), line_distinct / np.maximum(lines, 1), per(marks) / w1, per(upper) / w1,
        per(within(_TABLES["digit"]) > 0) / w1, pairs / np.maximum(words - 1, 1),
        entropy, np.sqrt(np.maximum(per(length**2) / w1 - mean**2, 0)), per(capital) / w1, twice / w1,
    ]
    return np.column_stack(cols) if n else np.zeros((0, len(FEATURES)))


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf points at itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 5, bins: int = 64, rate: float = 0.15, smooth: float = 2.0
) -> Trees:
    """Second-order boosting of logistic loss; splits are sought on histograms of binned columns."""
    n, width = x.shape
    share = (y.sum() + 1) / (n + 2)
    bias = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)]) if n else x
    flat = (binned + np.arange(width) * bins).astype(np.int64) if n else None
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, bias)

    def node() -> int:
        k = len(feature)
        for a, v in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, 0.0)):
            a.append(v)
        return k

    for _ in range(n_trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        level = [(root, np.arange(n))]
        for d in range(depth + 1):
            following = []
            for at, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, None)
                if d < depth and len(rows) >= 20:
                    cell = flat[rows].ravel()
                    hg = np.bincount(cell, weights=np.repeat(g[rows], width), minlength=width * bins).reshape(width, bins).cumsum(1)
                    hh = np.bincount(cell, weights=np.repeat(h[rows], width), minlength=width * bins).reshape(width, bins).cumsum(1)
                    ok = (hh > 1.0) & (hs - hh > 1.0)
                    gain = np.where(ok, hg**2 / (hh + smooth) + (gs - hg) ** 2 / (hs - hh + smooth) - gs**2 / (hs + smooth), 0)
                    j, b = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[j, b] > best[0] and b < len(cuts[j]):
                        best = (gain[j, b], (j, b))
                if best[1] is None:
                    value[at] = float(-rate * gs / (hs + smooth))
                    margin[rows] += value[at]
                    continue
                j, b = best[1]
                goes = binned[rows, j] <= b
                feature[at], threshold[at], left[at], right[at] = int(j), float(cuts[j][b]), node(), node()
                following += [(left[at], rows[goes]), (right[at], rows[~goes])]
            level = following
    return Trees(*(np.array(a) for a in (roots, feature, threshold, left, right, value)), bias=bias if n else 0.0, depth=depth)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, label: str = "quality") -> Trees:
    """Fit on the ``rows`` labelled documents whose ids hash lowest; ``labels`` holds the learnable rows only.

    The sample, and so what reaches the driver, is bounded by ``rows`` rows of statistics.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text")

    def measure(batch: pa.RecordBatch):
        x = statistics(batch.column("text"))
        yield pa.record_batch({"y": batch.column("y"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    got = texts.mapInArrow(sliced(measure), "y double, x array<double>").toArrow()
    y = got.column("y").to_numpy()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of arrival
    return fit_trees(x[order], y[order])


def score(docs: DataFrame, trees: Trees, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``), score and predicted for every document."""
    keep = keep or ["doc_id"]
    inner = docs.select("text", F.struct(*keep).alias("row"))

    def apply(batch: pa.RecordBatch):
        s = trees.score(statistics(batch.column("text")))
        yield pa.record_batch({"row": batch.column("row"), "score": pa.array(s)})

    out = inner.mapInArrow(sliced(apply), inner.select("row", F.lit(0.0).alias("score")).schema)
    return out.select("row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
