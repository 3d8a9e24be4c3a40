"""Toxicity: a linear-chain conditional random field tags toxic tokens in whole texts.

Labels come by document, so the labelled tokens are derived first: on a bounded sample of labelled
rows, words and word beginnings that stand in toxic documents and hardly in others are counted in
Spark; those that follow many different words are markers (what only comes along with copies of a
text does not). Tokens of toxic documents that carry one are labelled toxic, and a two-tag CRF over hashed word, prefix and suffix features is fitted to segments
around them and to segments of clean documents by full-batch gradient steps with forward-backward.

Scoring runs forward-backward over every token of a text, all texts of a slice side by side. The two
largest marginals, their sum over the text and its length give the document's score by a logistic
function fitted on the same sample; runs of tokens with a marginal of a half or more give the
offending offsets, counted in characters.

Defined results: a null, empty or wordless text scores 0 and has no offsets; a null doc_id counts as
the text ''; without toxic labels every score is 0; repeated rows are scored each on its own, and equal texts score alike; one text of
any length is scored whole, in a slice of its own; an empty table gives an empty result; other
columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bytes_of, sliced

_U = np.uint64
#: At most so many labelled rows of either kind are used to fit.
FIT_TOXIC, FIT_CLEAN = 3_000, 6_000
#: Hashed weights; segment length in tokens; segments that a toxic and a clean document of the sample give at most.
DIM, SEGMENT, PER_TOXIC, PER_CLEAN = 1 << 18, 15, 6, 3
#: Lengths in bytes of the word beginnings that are features and may be markers.
BEGINNINGS = (4, 5, 6, 7, 8, 9)
#: A marker stands in so many toxic documents and after so many different words at least.
LEAST = 4
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Tokens:
    """Word runs of packed texts; whole words, beginnings and endings as hashes."""

    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    word: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))
    parts: list[np.ndarray] = field(default_factory=list)


def tokens(texts: pa.Array) -> tuple[Tokens, np.ndarray, np.ndarray]:
    data, offsets = bytes_of(texts)
    low = K.lowered(data)
    starts, ends, docs = K._runs(_LETTER[data], offsets)
    t = Tokens(starts, ends, docs)
    sums = K.prefix_sums(low)
    t.word = K.run_hashes(sums, starts, ends)
    for n in BEGINNINGS:  # shorter words have no beginning of this length
        t.parts.append(np.where(ends - starts > n, K.run_hashes(sums, starts, np.minimum(starts + n, ends)) ^ K.mix(_U([n + 40])), _U(0)))
    t.parts.append(np.where(ends - starts > 3, K.run_hashes(sums, np.maximum(ends - 3, starts), ends) ^ K.mix(_U([90])), _U(0)))
    return t, data, offsets


def _columns(t: Tokens) -> np.ndarray:
    """The weight indexes of each token, one column a feature template; column 0 is the bias."""
    all_ = [t.word, *t.parts]
    cols = [(K.mix(h + _U(17 * k + 1)) % _U(DIM - 64)).astype(np.int32) + 64 for k, h in enumerate(all_)]
    return np.column_stack([np.zeros(len(t.word), np.int32), *cols]) if len(t.word) else np.zeros((0, len(BEGINNINGS) + 3), np.int32)


def _markers(t: Tokens) -> np.ndarray:
    """What may mark a toxic token: the word itself and its beginnings."""
    return np.column_stack([t.word, *t.parts[:-1]])


@dataclass
class Field:
    """Weights of the toxic tag's features and the log potentials of neighbouring tags."""

    weights: np.ndarray
    moves: np.ndarray
    #: Of the score: bias, then one for each column of ``evidence``.
    link: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def document_scores(self, marginals: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        x = evidence(marginals, docs, n)
        if not len(self.link):
            return np.zeros(n)
        some = np.bincount(docs, minlength=n) > 0
        return np.where(some, 1 / (1 + np.exp(-np.clip(self.link[0] + x @ self.link[1:], -50, 50))), 0.0)

    def marginals(self, scores: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """P(token is toxic) by forward-backward; scores are log potentials of toxic against clean."""
        n = len(scores)
        if not n:
            return np.zeros(0)
        first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        length = np.diff(np.append(first, n))
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # texts with a token at each step
        forward, back = np.empty(n), np.empty(n)
        f = None
        for k in range(length[0]):
            at = first[: alive[k]] + k
            f = scores[at] if f is None else scores[at] + self._step(f[: len(at)], self.moves)
            forward[at] = f
        last = first + length - 1
        b = None
        for k in range(length[0]):
            m = alive[k]
            at = last[:m] - k
            b = np.zeros(m) if k == 0 else self._step(b[:m] + scores[at + 1], self.moves.T)
            back[at] = b
        return 1 / (1 + np.exp(-np.clip(forward + back, -50, 50)))

    @staticmethod
    def _step(odds: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """Log odds after one move from a tag with these log odds; moves[from, to]."""
        return np.logaddexp(odds + moves[1, 1], moves[0, 1]) - np.logaddexp(odds + moves[1, 0], moves[0, 0])


def evidence(p: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Of each document: log odds of its two largest marginals, log of their sum, log of its length."""
    best, second = np.full(n, 1e-6), np.full(n, 1e-6)
    order = np.lexsort((p, docs))
    d = docs[order]
    if len(d):
        last = np.flatnonzero(np.append(d[1:] != d[:-1], True))
        best[d[last]] = p[order][last]
        two = last[(last > 0) & (d[np.maximum(last - 1, 0)] == d[last])]
        second[d[two]] = p[order][two - 1]
    odds = lambda x: np.log((q := np.clip(x, 1e-6, 1 - 1e-6)) / (1 - q))
    return np.column_stack([odds(best), odds(second), np.log1p(np.bincount(docs, weights=p, minlength=n)), np.log1p(np.bincount(docs, minlength=n))])


def fit_link(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * w)
    return w


def fit_field(x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = 100, rate: float = 0.5, decay: float = 1e-5) -> Field:
    """Maximise the likelihood of tags y over segments x[segment, position, feature] by Adagrad steps."""
    w, moves = np.zeros(DIM), np.zeros((2, 2))
    w[0] = -3.0
    g2, m2 = np.full(DIM, 1e-8), np.full((2, 2), 1e-8)
    n, length = y.shape
    if not n:
        return Field(w.astype(np.float32), moves)
    total = mask.sum()
    for _ in range(steps):
        s = w[x].sum(2)
        lf, lb = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        lf[:, 0, 1] = s[:, 0]
        for k in range(1, length):
            lf[:, k] = np.logaddexp(lf[:, k - 1, :1] + moves[0], lf[:, k - 1, 1:] + moves[1])
            lf[:, k, 1] += s[:, k]
            lf[:, k] = np.where(mask[:, k, None], lf[:, k], lf[:, k - 1])
        for k in range(length - 2, -1, -1):
            e = lb[:, k + 1] + np.stack([np.zeros(n), s[:, k + 1]], 1)
            lb[:, k] = np.where(mask[:, k + 1, None], np.logaddexp(moves[:, 0] + e[:, :1], moves[:, 1] + e[:, 1:]), lb[:, k + 1])
        z = np.logaddexp(lf[:, -1, 0], lf[:, -1, 1])[:, None]
        p = np.exp(np.minimum(lf[..., 1] + lb[..., 1] - z, 0))
        diff = np.where(mask, y - p, 0)
        grad = np.bincount(x.ravel(), weights=np.repeat(diff.ravel(), x.shape[2]), minlength=DIM) / total - decay * w
        gm = np.zeros((2, 2))
        both = mask[:, 1:] & mask[:, :-1]
        for a in (0, 1):
            for b in (0, 1):
                log_p = lf[:, :-1, a] + moves[a, b] + (s[:, 1:] if b else 0) + lb[:, 1:, b] - z
                seen = (y[:, :-1] == a) & (y[:, 1:] == b)
                gm[a, b] = (np.where(both, seen - np.exp(np.minimum(log_p, 0)), 0)).sum() / total
        gm -= decay * moves
        g2 += grad**2
        m2 += gm**2
        w += rate * grad / np.sqrt(g2)
        moves += 0.2 * gm / np.sqrt(m2)
    return Field(w.astype(np.float32), moves)


def fit(
    docs: DataFrame, labels: DataFrame, toxic_rows: int = FIT_TOXIC, clean_rows: int = FIT_CLEAN, label: str = "toxic",
    per_toxic: int = PER_TOXIC, per_clean: int = PER_CLEAN, least: int = LEAST,
) -> Field:
    """Fit on at most ``toxic_rows`` and ``clean_rows`` labelled documents, those whose ids hash lowest.

    ``per_toxic`` and ``per_clean`` bound the segments of one document of that sample, ``least`` is the fewest toxic
    documents that a marker stands in, and words that it follows; with fewer toxic documents in the sample, one of each is enough.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    pick = lambda y, n: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, toxic_rows).unionByName(pick(0, clean_rows))
    least = least if min(counts.get(1, 0), toxic_rows) >= least else 1
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text").where("text is not null").distinct().cache()

    def mark(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t, _, _ = tokens(batch.column("text"))
        m = _markers(t)
        values, owners = K.distinct_per_doc(m.ravel(), np.repeat(t.docs, m.shape[1]))
        y = batch.column("y").to_numpy()[owners]
        keep = values != 0
        yield pa.record_batch({"marker": pa.array(values[keep].view(np.int64)), "y": pa.array(y[keep].astype(np.int32))})

    counted = texts.mapInArrow(sliced(mark), "marker long, y int").groupBy("marker").agg(F.sum("y").alias("bad"), F.count("*").alias("all"))
    # the markers of a bounded sample of texts; all of them go on, so that copies of a few texts can't crowd others out
    good = counted.where((F.col("bad") >= least) & (F.col("all") - F.col("bad") <= 0.1 * F.col("bad")))
    rows_ = good.select("marker").toArrow()
    candidates = np.sort(rows_.column("marker").to_numpy().view(_U)) if rows_.num_rows else np.zeros(0, _U)

    def hit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t, _, _ = tokens(batch.column("text"))
        m = _markers(t)
        before = np.concatenate([np.zeros(1, _U), t.word[:-1]])[: len(t.word)]
        at, k = np.nonzero(np.isin(m, candidates)) if len(m) else (np.zeros(0, int), np.zeros(0, int))
        yield pa.record_batch({"marker": pa.array(m[at, k].view(np.int64)), "before": pa.array(before[at].view(np.int64))})

    met = texts.where("y = 1").mapInArrow(sliced(hit), "marker long, before long").groupBy("marker").agg(F.countDistinct("before").alias("n"))
    marks = met.where(F.col("n") >= least).select("marker").toArrow() if len(candidates) else None
    picked = np.sort(marks.column("marker").to_numpy().view(_U)) if marks is not None and marks.num_rows else np.zeros(0, _U)

    def segment(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t, _, _ = tokens(batch.column("text"))
        x = _columns(t)
        bad = np.isin(_markers(t), picked).any(1)
        y = batch.column("y").to_numpy()
        out_x, out_y, out_m = [], [], []
        for d in range(batch.num_rows):
            a, b = np.searchsorted(t.docs, [d, d + 1])
            if a == b:
                continue
            centres = np.flatnonzero(bad[a:b]) if y[d] else np.linspace(0, b - a - 1, per_clean).astype(int)
            if y[d] and len(centres) > per_toxic:
                centres = centres[np.linspace(0, len(centres) - 1, per_toxic).astype(int)]
            for c in centres:
                lo = max(a, min(a + c - SEGMENT // 2, b - SEGMENT))
                n = min(SEGMENT, b - lo)
                row = np.zeros((SEGMENT, x.shape[1]), np.int32)
                row[:n] = x[lo : lo + n]
                tags = np.zeros(SEGMENT, np.int8)
                tags[:n] = bad[lo : lo + n] & bool(y[d])
                out_x.append(row.tobytes())
                out_y.append(tags.tobytes())
                out_m.append(n)
        yield pa.record_batch({"x": pa.array(out_x, pa.binary()), "y": pa.array(out_y, pa.binary()), "n": pa.array(out_m, pa.int32())})

    seen = texts.mapInArrow(sliced(segment), "x binary, y binary, n int").toArrow() if len(picked) else None
    if seen is None or not seen.num_rows:
        texts.unpersist()
        return Field(np.concatenate([[-60.0], np.zeros(DIM - 1)]).astype(np.float32), np.zeros((2, 2)))
    xs, ys, ns = (seen.column(c).to_pylist() for c in ("x", "y", "n"))
    order = sorted(range(len(xs)), key=lambda i: (xs[i], ys[i]))
    x = np.stack([np.frombuffer(xs[i], np.int32).reshape(SEGMENT, -1) for i in order])
    y = np.stack([np.frombuffer(ys[i], np.int8) for i in order]).astype(float)
    found = fit_field(x, y, np.arange(SEGMENT) < np.array([ns[i] for i in order])[:, None])

    def weigh(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t, _, _ = tokens(batch.column("text"))
        e = evidence(found.marginals(found.weights[_columns(t)].sum(1, dtype=np.float64), t.docs), t.docs, batch.num_rows)
        yield pa.record_batch({"y": batch.column("y"), "e": pa.array(list(e), pa.list_(pa.float64()))})

    got = texts.mapInArrow(sliced(weigh), "y int, e array<double>").toArrow()
    texts.unpersist()
    target = got.column("y").to_numpy().astype(float)
    e = np.array(got.column("e").to_pylist(), float).reshape(len(target), -1)
    order = np.lexsort((*e.T, target))  # the same weights whatever the order of arrival
    shares = {v: counts.get(v, 0) / max(1, (target == v).sum()) for v in (0, 1)}
    weight = np.where(target == 1, shares[1], shares[0]) * len(target) / max(1, sum(counts.values()))
    found.link = fit_link(e[order], target[order], weight[order])
    return found


def score(docs: DataFrame, field_: Field, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``), score, predicted, spans (begin and end in characters, probability)."""
    keep = keep or ["doc_id"]
    inner = docs.select("text", F.struct(*keep).alias("row"))

    def apply(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t, data, offsets = tokens(batch.column("text"))
        n = batch.num_rows
        x = _columns(t)
        p = field_.marginals(field_.weights[x].sum(1, dtype=np.float64), t.docs)
        best = field_.document_scores(p, t.docs, n)
        bad = np.flatnonzero(p >= 0.5)
        new = np.concatenate([[True], (bad[1:] != bad[:-1] + 1) | (t.docs[bad[1:]] != t.docs[bad[:-1]])]) if len(bad) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        first = bad[head]
        last = bad[np.append(head[1:], len(bad)) - 1] if len(bad) else first
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = chars[offsets[t.docs[first]]] if len(first) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(p[bad], head) if len(bad) else np.zeros(0)
        spans = pa.StructArray.from_arrays(
            [pa.array((chars[t.starts[first]] - base).astype(np.int32)), pa.array((chars[t.ends[last]] - base).astype(np.int32)), pa.array(most)], ["begin", "end", "p"]
        )
        ends = np.concatenate([[0], np.cumsum(np.bincount(t.docs[first], minlength=n) if len(first) else np.zeros(n, int))]).astype(np.int32)
        yield pa.record_batch({"row": batch.column("row"), "score": pa.array(best), "spans": pa.ListArray.from_arrays(ends, spans)})

    shape = inner.select("row", F.lit(0.0).alias("score"), F.array().cast("array<struct<begin:int,end:int,p:double>>").alias("spans")).schema
    out = inner.mapInArrow(sliced(apply), shape)
    return out.select("row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
