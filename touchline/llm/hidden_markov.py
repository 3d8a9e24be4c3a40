"""Scores texts with a hidden Markov language model, trained by Baum-Welch over the whole corpus.

Texts are cut into words once and stored in blocks: packed word numbers with a list of the block's
own words. Training begins with tied emissions: words share one of ``TIED`` classes by hash, so that
the model is small and every task can hold it; each pass sums the expected counts of all blocks. A
last pass counts state by word without ties, for every word of the corpus, summed by word in a
shuffle; the vocabulary is never held by one task. For scoring a block gets back the rows of its own
words. The scaled forward recursion then gives each text's likelihood, without approximation.

Expected counts are rounded to 1/1024 in each block and summed as whole numbers, and noise is
derived from hashes, so a rerun gives the same model.

A text is its words followed by one end. Words without training count are one event, unknown, whose
probability in a state is the share of words met once (what would be unknown, were it left out).
Emissions, unknown included, sum to 1 in each state, so all texts' probabilities sum to 1.

Long texts are cut into pieces of ``PIECE`` words. A piece's effect on any state distribution is a
matrix, made from one recursion for each state; products of these give what enters and leaves each
piece, so pieces of one text are computed side by side, and exactly.

Defined results: null and empty texts are just an end; a null doc_id counts as the text ''; without any training text every word is unknown and all scores come from the smoothing; rows
with equal ids are scored each for itself; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, forget, numbered, stored
from .kernels import lowered, mix, prefix_sums, run_hashes, space_words, spaces
from .quality import held_out

STATES = 8
#: Classes of the tied emissions, the end besides.
TIED = 1 << 15
#: Text bytes of a block; one longer text makes a block of its own.
BLOCK_BYTES = 16 << 20
PIECE = 2048
#: Word positions whose state probabilities are held at once.
_HELD = 1 << 19
UNIT = 1024
#: Stands for the end of a text; no word can hold a line feed.
END = "\n"
_BLOCK = "block string, ids array<bigint>, held array<boolean>, ends array<bigint>, tokens binary, words array<string>, counts array<bigint>, classes binary"


def _pack(texts: pa.Array, ids: list, held: np.ndarray) -> pa.RecordBatch:
    data, offsets = bytes_of(texts)
    starts, ends, doc = space_words(data, offsets)
    lengths = ends - starts
    place = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(place), pa.py_buffer(lowered(data[~spaces(data)])))
    coded = words.dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(held)
    closing = np.cumsum(np.bincount(doc, minlength=n)) if len(doc) else np.zeros(n, np.int64)
    tokens = np.insert(codes, closing, len(names)).astype(np.int32)
    rows = np.repeat(np.arange(n), np.diff(closing, prepend=0) + 1)
    counts = np.bincount(tokens[~held[rows]], minlength=len(names) + 1)
    name_data, name_offsets = bytes_of(names)
    hashed = run_hashes(prefix_sums(name_data), name_offsets[:-1], name_offsets[1:])
    classes = np.append((hashed >> np.uint64(17)) % np.uint64(TIED), TIED).astype(np.int32)
    row = {
        "block": [uuid.uuid4().hex], "ids": [ids], "held": [held.tolist()], "ends": [closing + 1 + np.arange(n)], "tokens": [tokens.tobytes()],
        "words": [[*names.to_pylist(), END]], "counts": [counts], "classes": [classes.tobytes()],
    }
    kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


def _make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def packed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        return _pack(rows["text"].chunk(0), rows["row_id"].to_pylist(), rows["held_out"].to_numpy())

    for batch in batches:
        _, ends = bytes_of(batch.column("text"))
        begin = 0
        for k in range(batch.num_rows):
            more = int(ends[k + 1] - ends[k])
            if size and size + more > BLOCK_BYTES:
                if k > begin:
                    held.append(batch.slice(begin, k - begin))
                yield packed()
                held, size, begin = [], 0, k
            size += more
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield packed()


class Chain:
    """Start and step probabilities, with the recursions over many pieces of texts side by side."""

    def __init__(self, start: np.ndarray, steps: np.ndarray):
        self.start, self.steps = start, steps

    def _walk(self, emit: np.ndarray, at: np.ndarray, n: np.ndarray, begin: np.ndarray, every: bool) -> tuple:
        """Scaled forward recursion; pieces fall in length. ``at`` has the place of each step's first row.

        ``every`` keeps the state probabilities and scales of all steps in place of the logarithms.
        """
        size = emit.shape[1]
        ones = np.ones(size, emit.dtype)
        steps, states = self.steps.astype(emit.dtype), begin.astype(emit.dtype)
        logs = np.zeros(len(begin))
        alpha = np.empty_like(emit) if every else None
        scale = np.empty(len(emit), emit.dtype) if every else None
        for t in range(len(n)):
            k, here = n[t], slice(at[t], at[t + 1])
            now = states[:k] if t == 0 else states[:k] @ steps
            now = now * emit[here]
            total = now @ ones
            now /= total[:, None]
            states[:k] = now
            if every:
                alpha[here], scale[here] = now, total
            else:
                logs[:k] += np.log(total)
        return logs, alpha, scale

    def _effects(self, emit: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each piece the matrix from the state predicted for its first word to its last state, but for a factor."""
        size = emit.shape[1]
        ones = np.ones(size * size)
        found = np.eye(size)[None] * emit[: n[0], None, :]
        for t in range(1, len(n)):
            k = n[t]
            now = (found[:k].reshape(-1, size) @ self.steps).reshape(k, size, size)
            now *= emit[at[t] : at[t + 1], None, :]
            if t % 8 == 0:
                now /= (now.reshape(k, -1) @ ones)[:, None, None]
            found[:k] = now
        return found / (found.reshape(len(found), -1) @ ones)[:, None, None]

    def pieces(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, length, text) of each piece, texts in order."""
        starts = np.concatenate([[0], ends[:-1]])
        parts = -(-(ends - starts) // PIECE)
        text = np.repeat(np.arange(len(ends)), parts)
        within = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = starts[text] + within * PIECE
        return first, np.minimum(PIECE, ends[text] - first), text

    @staticmethod
    def _groups(lengths: np.ndarray, some: np.ndarray) -> Iterator[np.ndarray]:
        order = some[np.argsort(-lengths[some], kind="stable")]
        while len(order):
            fits = max(1, int(np.searchsorted(np.cumsum(lengths[order]), _HELD, side="right")))
            yield order[:fits]
            order = order[fits:]

    @staticmethod
    def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, lengths[0] + 1), side="left")
        return n, np.concatenate([[0], np.cumsum(n)])

    @staticmethod
    def _turned(first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Token places in the order of steps: all first words, then all second ones, ..."""
        return np.concatenate([first[: n[t]] + t for t in range(len(n))])

    def entering(self, tokens: np.ndarray, emit: np.ndarray, ends: np.ndarray, back: bool) -> tuple:
        """(pieces..., what enters each piece, what its last state is worth for the rest of the text)."""
        first, length, text = self.pieces(ends)
        size = len(self.start)
        enters = np.broadcast_to(self.start, (len(first), size)).copy()
        leaves = np.ones((len(first), size))
        joins = np.zeros((size, size))
        several = np.flatnonzero(np.bincount(text, minlength=len(ends))[text] > 1)
        if not len(several):
            return first, length, enters, leaves, joins
        effect = np.empty((len(first), size, size))
        for part in self._groups(length, several):
            n, at = self._layout(length[part])
            effect[part] = self._effects(emit[tokens[self._turned(first[part], n)]], at, n)
        for k in several:
            if k and text[k - 1] == text[k]:
                out = enters[k - 1] @ effect[k - 1]
                out = out @ self.steps
                enters[k] = out / out.sum()
        if back:
            for k in several[::-1]:
                if k + 1 < len(text) and text[k + 1] == text[k]:
                    worth = effect[k + 1] @ leaves[k + 1]
                    leaves[k] = self.steps @ (worth / worth.max())
                    last = enters[k] @ effect[k]
                    joint = last[:, None] * self.steps * worth
                    joins += joint / joint.sum()
        return first, length, enters, leaves, joins

    def likelihood(self, tokens: np.ndarray, emit: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The natural logarithm of each text's probability; ``emit`` has a row for each code in ``tokens``."""
        first, length, enters, _, _ = self.entering(tokens, emit, ends, False)
        _, _, text = self.pieces(ends)
        logs = np.zeros(len(first))
        for part in self._groups(length, np.arange(len(first))):
            n, at = self._layout(length[part])
            logs[part] = self._walk(emit[tokens[self._turned(first[part], n)]], at, n, enters[part], False)[0]
        return np.bincount(text, weights=logs, minlength=len(ends))

    def expected(self, tokens: np.ndarray, emit: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts: (state of the first word, step from state to state, code by state); single precision within pieces."""
        size = len(self.start)
        starts, by_code = np.zeros(size), np.zeros((len(emit), size))
        first, length, enters, leaves, steps = self.entering(tokens, emit, ends, True)
        opens = np.isin(first, np.concatenate([[0], ends[:-1]]))
        light, back = emit.astype(np.float32), np.ascontiguousarray(self.steps.T.astype(np.float32))
        for part in self._groups(length, np.arange(len(first))):
            n, at = self._layout(length[part])
            order = tokens[self._turned(first[part], n)]
            b = light[order]
            _, alpha, scale = self._walk(b, at, n, enters[part], True)
            beta = leaves[part]
            beta = (beta / (self._ends(alpha, at, n) * beta).sum(axis=1, keepdims=True)).astype(b.dtype)
            b /= scale[:, None]
            ahead = np.empty_like(b)
            for t in range(len(n) - 1, -1, -1):
                k, here = n[t], slice(at[t], at[t + 1])
                np.multiply(b[here], beta[:k], out=ahead[here])
                np.multiply(alpha[here], beta[:k], out=b[here])
                np.matmul(ahead[here], back, out=beta[:k])
            for s in range(size):
                by_code[:, s] += np.bincount(order, weights=b[:, s], minlength=len(emit))
            starts += b[: n[0]][opens[part]].sum(axis=0, dtype=float)
            if len(n) > 1:
                before = np.concatenate([np.arange(at[t], at[t] + n[t + 1]) for t in range(len(n) - 1)])
                steps = steps + self.steps * (alpha[before].T @ ahead[at[1] :]).astype(float)
        return starts, steps, by_code

    @staticmethod
    def _ends(alpha: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The last state probabilities of each piece."""
        out = np.empty((n[0], alpha.shape[1]))
        for t in range(len(n) - 1, -1, -1):
            k = n[t + 1] if t + 1 < len(n) else 0
            out[k : n[t]] = alpha[at[t] + k : at[t + 1]]
        return out


def _block_arrays(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["tokens"], np.int32), np.asarray(row["ends"], np.int64)


def _teaching(tokens: np.ndarray, ends: np.ndarray, teaches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens and ends of the texts that teach."""
    lengths = np.diff(ends, prepend=0)
    return tokens[np.repeat(teaches, lengths)], np.cumsum(lengths[teaches])


def _whole(counts: np.ndarray) -> np.ndarray:
    return np.rint(counts * UNIT).astype(np.int64)


def _tied_counts(chain: Chain, emit: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Expected counts of a task's blocks: rows (slot, one column a state); class by state, then start, then steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(chain.start)
        total = np.zeros((TIED + 2 + size, size), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                tokens, ends = _teaching(*_block_arrays(row), ~np.asarray(row["held"], bool))
                if len(ends):
                    starts, steps, by_code = chain.expected(np.frombuffer(row["classes"], np.int32)[tokens], emit, ends)
                    total += _whole(np.concatenate([by_code, starts[None], steps]))
        met = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *(pa.array(total[met, s]) for s in range(size))], names=["slot", *(f"s{s}" for s in range(size))])

    return run


def _noise(rows: int, states: int) -> np.ndarray:
    """Fixed factors around 1 that make the states differ before the first pass."""
    bits = mix(np.arange(rows * states, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(11))
    return np.exp((bits >> np.uint64(11)).astype(np.float64) / (1 << 53) * 2 - 1).reshape(rows, states)


def _normal(x: np.ndarray, least: float = 0.0) -> np.ndarray:
    x = x + least
    return x / x.sum(axis=-1, keepdims=True)


def fit_tied(blocks: DataFrame, states: int = STATES, passes: int = 4) -> tuple[Chain, np.ndarray]:
    """The chain and the emissions by class after ``passes`` Baum-Welch passes; their counts have a fixed size, whatever the corpus."""
    chain = Chain(np.full(states, 1 / states), np.full((states, states), 0.1 / max(states - 1, 1)) * (1 - np.eye(states)) + np.eye(states) * (0.9 if states > 1 else 1.0))
    emit = _noise(TIED + 1, states)
    schema = "slot int, " + ", ".join(f"s{s} bigint" for s in range(states))
    for _ in range(passes):
        rows = blocks.select("ends", "held", "tokens", "classes").mapInArrow(_tied_counts(chain, emit), schema)
        got = rows.groupBy("slot").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states))).toPandas().to_numpy(np.int64)
        if not len(got):
            break
        total = np.zeros((TIED + 2 + states, states))
        total[got[:, 0]] = got[:, 1:] / UNIT
        words = total[: TIED + 1]
        shared = words.sum(axis=1, keepdims=True)
        background = shared / shared.sum()
        smooth = (words + 20.0 * background) / (words.sum(axis=0) + 20.0)
        emit = smooth + 1e-12
        chain = Chain(_normal(total[TIED + 1], 0.1), _normal(total[TIED + 2 :], 0.1))
    return chain, emit


def _word_counts(chain: Chain, emit: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """word, c, one column a state, of a task's blocks, words without training count left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(chain.start)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).select(["ends", "held", "tokens", "classes"]).to_pylist()[0]
                tokens, ends = _teaching(*_block_arrays(row), ~np.asarray(row["held"], bool))
                if not len(ends):
                    continue
                classes = np.frombuffer(row["classes"], np.int32)
                _, _, by_code = chain.expected(tokens, emit[classes], ends)
                c = np.bincount(tokens, minlength=len(classes))
                met = np.flatnonzero(c)
                words = batch.column("words")[k].values.take(pa.array(met))
                by_state = _whole(by_code[met])
                for a in range(0, len(met), 10_000):
                    part = slice(a, a + 10_000)
                    yield pa.RecordBatch.from_arrays(
                        [words[part], pa.array(c[met[part]].astype(np.int64)), *(pa.array(by_state[part, s]) for s in range(size))], names=["word", "c", *(f"s{s}" for s in range(size))]
                    )

    return run


def learn_words(blocks: DataFrame, chain: Chain, emit: np.ndarray) -> DataFrame:
    """word, c, shares: training count of every word, and 255ths of it by state, the last pass of Baum-Welch."""
    size = len(chain.start)
    schema = "word string, c bigint, " + ", ".join(f"s{s} bigint" for s in range(size))
    rows = blocks.select("ends", "held", "tokens", "classes", "words").mapInArrow(_word_counts(chain, emit), schema)
    summed = rows.groupBy("word").agg(F.sum("c").alias("c"), *(F.sum(f"s{s}").alias(f"s{s}") for s in range(size)))
    shares = F.array(*(F.round(F.lit(255.0) * F.col(f"s{s}") / (F.col("c") * UNIT)).cast("smallint") for s in range(size)))
    return summed.select("word", "c", shares.alias("shares"))


class Emissions:
    """What the states emit, from the totals of all words; known words by their count and shares."""

    def __init__(self, words: DataFrame, states: int, steady: float = 50.0):
        sums = [F.sum(F.col("c") * F.col("shares")[s]).alias(f"n{s}") for s in range(states)]
        once = [F.sum(F.when(F.col("c") == 1, F.col("shares")[s])).alias(f"o{s}") for s in range(states)]
        row = words.agg(F.count("*").alias("v"), F.sum("c").alias("n"), *sums, *once).first()
        self.distinct, self.total, self.steady = row["v"], row["n"] or 0, steady
        self.by_state = np.array([(row[f"n{s}"] or 0) / 255 for s in range(states)])
        met_once = np.array([(row[f"o{s}"] or 0) / 255 for s in range(states)])
        self.unknown = (met_once + 0.5) / (self.by_state + 1.0)
        self.unknown = np.minimum(self.unknown, 0.5) if self.total else np.ones(states)

    def rows(self, c: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """A row of probabilities for each word; words with c = 0 are unknown."""
        if not self.total:
            return np.ones((len(c), len(self.unknown)))
        known = (c[:, None] * shares / 255 + self.steady * c[:, None] / self.total) / (self.by_state + self.steady)
        return np.where(c[:, None] > 0, (1 - self.unknown) * known, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def _score_block(chain: Chain, emissions: Emissions) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        row = block.select(["ids", "held", "ends", "tokens"]).to_pylist()[0]
        tokens, ends = _block_arrays(row)
        size = len(chain.start)
        width = int(tokens.max()) + 1
        c, shares = np.zeros(width, np.int64), np.zeros((width, size))
        if len(found):
            place = found["place"].to_numpy()
            c[place] = found["c"].to_numpy()
            shares[place] = np.concatenate([x.flatten().to_numpy() for x in found["shares"].chunks]).reshape(-1, size)
        score = chain.likelihood(tokens, emissions.rows(c, shares), ends) / np.log(10)
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        base = np.bincount(text, weights=emissions.base(c)[tokens], minlength=len(ends))
        known = np.bincount(text, weights=c[tokens] > 0, minlength=len(ends)).astype(np.int64)
        return pa.table({"row_id": row["ids"], "held_out": row["held"], "n_tokens": np.diff(ends, prepend=0), "n_known": known, "base_score": base, "score": score}, schema=_SCORED)

    return run


_SCORED_SQL = "row_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
_SCORED = pa.schema([("row_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def blocks_of(docs: DataFrame) -> DataFrame:
    """``docs`` (row_id, held_out, text) as blocks of tokenized texts."""
    return docs.select("row_id", "held_out", "text").mapInArrow(_make_blocks, _BLOCK)


def score(docs: DataFrame, states: int = STATES, passes: int = 4, folds: int = 10, out: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    Texts whose crc32(doc_id as text) mod ``folds`` is ``out`` do not teach. ``passes`` tied passes of
    Baum-Welch come before the one that counts every word.
    """
    spark, scratch = docs.sparkSession, []
    base = numbered(docs.select("doc_id", "text")).withColumn("held_out", F.coalesce(held_out(F.col("doc_id"), folds, out), F.lit(False)))
    blocks = stored(blocks_of(base), scratch)
    chain, emit = fit_tied(blocks, states, passes)
    words = stored(learn_words(blocks, chain, emit), scratch)
    emissions = Emissions(words, states)
    own = blocks.select(F.col("block").alias("at"), F.posexplode("words").alias("place", "word")).join(words, "word").select("at", "place", "c", "shares")
    texts = blocks.select("block", "ids", "held", "ends", "tokens")
    scored = texts.groupBy("block").cogroup(own.groupBy("at")).applyInArrow(_score_block(chain, emissions), _SCORED_SQL)
    scored = stored(scored)
    forget(spark, scratch)
    named = scored.join(base.select("row_id", "doc_id"), "row_id")
    return named.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(emissions.total).cast("long").alias("train_tokens"), "base_score", "score")
