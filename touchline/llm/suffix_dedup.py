"""Exact removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

Suffixes are first thrown into buckets by their q-gram. Not every suffix is kept: of the q-grams
inside each 200-byte string the one with the least scrambled hash stands for it (leftmost on a tie),
so two equal strings are always stood for by equal q-grams at equal offsets and meet in one bucket.
About one suffix in seventy remains. A run is the range of strings that one suffix stands for.

Buckets are refined by the identifiers of longer stretches around their suffixes: a bucket of one is
dropped; runs of one bucket whose whole stretch has the same identifier are settled at once and the
outcome is reused for all of them; only one member of each stretch that is left goes on to the last
refinement, which compares the identifiers of the single 200-byte strings. Identifiers are 64-bit
hashes of the bytes that they stand for, so that tasks agree on them without a global sort.

Large buckets are refined string by string over the cluster (counts are summed before the shuffle),
small ones within the partition that holds them. Texts are never compared pair by pair.

Defined results: a null or empty text has 0 bytes, nothing removed and the hash of no bytes; texts
shorter than ``length`` lose nothing; rows with equal or null doc_id are documents of their own; an
empty table gives an empty result; other columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bytes_of, forget, numbered, release, sliced, stored

LENGTH = 200
#: Length of the q-grams of the initial buckets.
Q = 64
#: Buckets with more different stretches than this are refined over the cluster.
LARGE_BUCKET = 1000
_U = np.uint64


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, q: int = Q):
    """(start, end, anchor, bucket, stretch) of each run: the strings that start in [start, end) share an anchor."""
    n, width = len(data), length - q + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(_U), none.astype(_U)
    sums = K.prefix_sums(data)
    _, down = K.powers(n + 1)
    m = n - q + 1
    gram = K.mix((sums[q:] - sums[:m]) * down[:m])
    bits = _U(26 if n < 1 << 26 else 34)
    key = (gram >> bits << bits) | np.arange(m, dtype=_U)
    k = m - width + 1
    padded = np.full(-(-m // width) * width, np.iinfo(np.uint64).max, _U)
    padded[:m] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[:k], ahead[width - 1 : width - 1 + k]) & ((_U(1) << bits) - _U(1))).astype(np.int64)
    inside = np.arange(k) + length <= np.repeat(offsets[1:], np.diff(offsets))[:k]
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])]))
    ends = np.append(edge[1:], k)
    good = inside[edge]
    start, end = edge[good], ends[good]
    anchor = at[start]
    stretch = K.run_hashes(sums, start, end - 1 + length) ^ K.mix((anchor - start).astype(_U) + _U(5))
    return start, end, anchor, gram[anchor], stretch


def _runs(length: int, q: int):
    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = bytes_of(batch.column("text"))
        start, end, anchor, bucket, stretch = anchor_runs(data, offsets, length, q)
        doc = np.searchsorted(offsets, start, side="right") - 1
        ids = batch.column("row_id").to_numpy()[doc]
        yield pa.record_batch(
            {
                "row_id": pa.array(ids), "start": pa.array((start - offsets[doc]).astype(np.int32)), "n": pa.array((end - start).astype(np.int32)),
                "bucket": pa.array(bucket.view(np.int64)), "stretch": pa.array(stretch.view(np.int64)),
            }
        )

    return fn


def _spans(length: int):
    """Cut the bytes of the asked stretches out of each text."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = bytes_of(batch.column("text"))
        asked = batch.column("asked")
        doc = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
        flat = asked.flatten()
        begin = flat.field("start").to_numpy() + offsets[doc]
        size = flat.field("n").to_numpy() + length - 1
        lengths = np.concatenate([[0], np.cumsum(size)])
        index = np.repeat(begin - lengths[:-1], size) + np.arange(lengths[-1])
        spans = pa.Array.from_buffers(
            pa.binary(), len(size), [None, pa.py_buffer(lengths.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[index]))]
        )
        yield pa.record_batch(
            {"row_id": pa.array(batch.column("row_id").to_numpy()[doc]), "start": flat.field("start"), "n": flat.field("n"), "bucket": flat.field("bucket"),
             "large": flat.field("large"), "single": flat.field("single"), "span": spans}
        )

    return fn


def _strings(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset in its stretch, identifier) of every 200-byte string of the batch's stretches."""
    data, offsets = bytes_of(batch.column("span"))
    n = batch.column("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = offsets[row] + shift
    return row, shift, K.run_hashes(K.prefix_sums(data), begin, begin + length)


def _intervals(batch: pa.RecordBatch, row: np.ndarray, shift: np.ndarray, length: int) -> pa.RecordBatch:
    """Maximal ranges of neighbouring repeated strings, as byte ranges of the documents."""
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shift[1:] != shift[:-1] + 1)])) if len(row) else row
    last = np.append(first[1:], len(row)) - 1 if len(row) else row
    begin = batch.column("start").to_numpy()[row[first]] + shift[first]
    return pa.record_batch(
        {"row_id": pa.array(batch.column("row_id").to_numpy()[row[first]]), "begin": pa.array(begin.astype(np.int32)),
         "end": pa.array((begin + (shift[last] - shift[first]) + length).astype(np.int32))}
    )


def _small_buckets(length: int):
    """Partitions arrive sorted by bucket: a bucket is refined when its last row has been seen."""

    def refine(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, shift, ids = _strings(batch, length)
        _, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        keep = (counts[inverse] > 1) & batch.column("single").to_numpy(zero_copy_only=False)[row]
        return _intervals(batch, row[keep], shift[keep], length)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                bucket = batch.column("bucket").to_numpy()
                cut = int(np.flatnonzero(bucket != bucket[-1]).max(initial=-1)) + 1
                if cut:
                    done = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()
                    yield from (refine(x) for x in done)
                    held = []
                held.append(batch.slice(cut))
        if held:
            yield from (refine(x) for x in pa.Table.from_batches(held).combine_chunks().to_batches())

    return fn


def _single_strings(length: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                row, shift, ids = _strings(batch, length)
                take = lambda name: pa.array(batch.column(name).to_numpy(zero_copy_only=False)[row])  # noqa: B023, E731
                begin = (batch.column("start").to_numpy()[row] + shift).astype(np.int32)
                yield pa.record_batch({"row_id": take("row_id"), "begin": pa.array(begin), "single": take("single"), "string": pa.array(ids.view(np.int64))})

    return fn


def repeated_ranges(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """row_id, begin, end: byte ranges that together are exactly the bytes of repeated strings.

    ``docs`` has row_id (long, unique) and text. Ranges of one document may touch or overlap.
    """
    spark, first, gone = docs.sparkSession, [], []
    runs = docs.select("row_id", "text").mapInArrow(sliced(_runs(length, q)), "row_id long, start int, n int, bucket long, stretch long")
    runs = stored(runs, first)
    shared = stored(
        runs.groupBy("bucket").agg(F.count("*").alias("c"), F.min("stretch").alias("a"), F.max("stretch").alias("b"))
        .where("c > 1").select(F.col("bucket").alias("k"), (F.col("a") != F.col("b")).alias("mixed")), gone,
    )
    release(spark)
    met = stored(runs.join(shared, F.expr("bucket = k")).select("row_id", "start", "n", "mixed", *(F.when(F.col("mixed"), F.col(c)).alias(c) for c in ("bucket", "stretch"))))
    forget(spark, first)
    forget(spark, gone)
    release(spark)
    span = lambda df: df.select("row_id", F.col("start").alias("begin"), (F.col("start") + F.col("n") - 1 + length).cast("int").alias("end"))
    settled = span(met.where("not mixed"))
    left = met.where("mixed")
    stretches = stored(
        left.groupBy("bucket", "stretch").agg(F.count("*").alias("c"), F.min(F.struct("row_id", "start", "n")).alias("one"))
    )
    again = stretches.where("c > 1").select(F.col("bucket").alias("k"), F.col("stretch").alias("s"))
    settled = settled.unionByName(span(left.join(stored(again), F.expr("bucket = k and stretch = s"))))
    wide = stored(stretches.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > LARGE_BUCKET).select(F.col("bucket").alias("w")))
    asked = (
        stretches.join(wide, F.expr("bucket = w"), "left")
        .select("one.row_id", F.struct("one.start", "one.n", "bucket", F.col("w").isNotNull().alias("large"), (F.col("c") == 1).alias("single")).alias("x"))
        .groupBy("row_id").agg(F.collect_list("x").alias("asked"))
    )
    found = docs.select("row_id", "text").join(asked, "row_id").mapInArrow(
        sliced(_spans(length)), "row_id long, start int, n int, bucket long, large boolean, single boolean, span binary"
    )
    spans = stored(found)
    release(spark)
    ranges = "row_id long, begin int, end int"
    near = spans.where("not large").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_small_buckets(length), ranges)
    far = stored(spans.where("large").mapInArrow(_single_strings(length), "row_id long, begin int, single boolean, string long"))
    twice = stored(far.groupBy("string").agg(F.count("*").alias("c")).where("c > 1").select(F.col("string").alias("t")))
    wide_ranges = far.where("single").join(twice, F.expr("string = t")).select("row_id", "begin", (F.col("begin") + length).cast("int").alias("end"))
    return settled.unionByName(near).unionByName(wide_ranges)


def _union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal ranges of the union of ranges; ranges that touch become one."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(begin)) - 1
    return begin[new], reach[last]


def _cut(with_text: bool):
    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = bytes_of(batch.column("text"))
        asked = batch.column("ranges")
        at = asked.offsets.to_numpy()
        flat = asked.flatten()
        begins, ends = flat.field("begin").to_numpy(), flat.field("end").to_numpy()
        at = at - at[0]
        removed, spans, digests, kept_texts = [], [], [], []
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            gone = count = 0
            if at[i + 1] > at[i]:
                b, e = _union(begins[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])
                gone, count = int((e - b).sum()), len(b)
                edges = np.zeros(len(text) + 1, np.int8)
                edges[b] += 1
                edges[e] -= 1
                text = text[np.cumsum(edges[:-1], dtype=np.int8) == 0]
            removed.append(gone)
            spans.append(count)
            digests.append(hashlib.sha256(text).hexdigest())
            if with_text:
                kept_texts.append(text.tobytes())
        out = {"row": batch.column("row"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if with_text:
            out["kept"] = pa.array(kept_texts, pa.binary())
        yield pa.record_batch(out)

    return sliced(fn)


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, carry: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id (or ``carry``), n_bytes, n_removed, n_spans, kept_sha256 and, on demand, the kept bytes."""
    carry = carry or ["doc_id"]
    base = numbered(docs.select("doc_id", "text", F.struct(*carry).alias("row")))
    ranges = repeated_ranges(base, length, q)
    per = stored(ranges.groupBy("row_id").agg(F.collect_list(F.struct("begin", "end")).alias("ranges")))
    release(docs.sparkSession)
    empty = F.array().cast("array<struct<begin:int,end:int>>")
    inner = base.select("row_id", "row", "text").join(per, "row_id", "left").select("row", "text", F.coalesce("ranges", empty).alias("ranges"))
    schema = inner.select("row", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lit("").alias("kept_sha256"), *([F.lit(b"").alias("kept")] if with_text else [])).schema
    return inner.mapInArrow(_cut(with_text), schema).select("row.*", *schema.names[1:])
