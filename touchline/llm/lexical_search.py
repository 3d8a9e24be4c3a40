"""Ranked lexical search by three passes over term-partitioned postings (TPUT).

Each document becomes one row with the query terms it holds; from these come the postings, dealt
out and sorted by term and falling impact, so that a frequent term's list is spread over partitions.

1. The heads of all lists give lower bounds; an item's 20th best is a score that its results reach.
2. A document below that score divided by the item's terms in every list cannot reach it, so each
   list is read down to this uniform threshold only. What is read is dealt by document; sums of the
   parts read bound a document's score from below, and the thresholds of the rest from above.
3. Documents whose upper bound reaches the 20th best lower bound are looked up in the postings, and
   their exact scores are ranked.

Items are taken in blocks of bounded size, each against all documents; only a block's terms and its
weights are held by the driver and by every task. All scores are whole numbers.

Defined results: null texts have no terms and do not count; an item without terms, or whose terms no
document holds, has no rows; items with equal ids are ranked each for itself; documents with equal
ids are documents of their own; a null doc_id comes last among equals; empty tables give an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, bytes_of, forget, lower_ascii, numbered, sliced, stored
from .divergence import term_array, term_counts

BROADCAST_ROWS = 200_000
#: Items of a block, and the sum of their distinct terms, unless one item alone has more.
BLOCK_ITEMS = 2_000
BLOCK_TERMS = 1_000_000
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_HELD = "row_id bigint, n bigint, terms array<int>, tfs array<bigint>"
_BOUNDS = "item int, row_id bigint, low bigint, high bigint"
#: Sums that a task holds at once while it bounds the scores of documents.
_CELLS = 2_000_000


def item_terms(items: DataFrame) -> DataFrame:
    """row_id, terms array<struct<term, times>> for every item with a term."""
    words = F.filter(F.split(lower_ascii(F.coalesce("text", F.lit(""))), _GAP), lambda w: w != "")
    per = items.select("row_id", F.explode(words).alias("term")).groupBy("row_id", "term").agg(F.count("*").alias("times"))
    return per.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("term", "times"))).alias("terms"))


def _blocks(items: DataFrame) -> Iterator[list]:
    block: list = []
    held = 0
    for row in items.toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or held + len(row["terms"]) > BLOCK_TERMS):
            yield block
            block, held = [], 0
        block.append(row)
        held += len(row["terms"])
    if block:
        yield block


def held_terms(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """row_id, n (all terms of the text) and the terms of the vocabulary that it holds, by their places there, with how often."""
    known = pa.array(vocabulary, pa.string())

    def of_slice(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        terms, at = term_array(*bytes_of(batch.column("text")), _INSIDE)
        doc, code, tf, names = term_counts(terms, at)
        place = pc.index_in(names, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        place = place[code]
        met = place >= 0
        doc, place, tf = doc[met], place[met], tf[met]
        ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        n = np.bincount(at, minlength=batch.num_rows).astype(np.int64)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (place, tf.astype(np.int64))]
        whole = pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(n), *lists], names=["row_id", "n", "terms", "tfs"])
        yield whole.filter(pa.array(n > 0))

    return docs.select("row_id", "text").mapInArrow(sliced(of_slice, limit=4 << 20), _HELD)


def impact(tf: Column, n: Column, n_docs: int, n_terms: int) -> Column:
    m = F.lit(75).cast("long") + F.call_function("div", n * F.lit(25 * n_docs).cast("long"), F.lit(n_terms).cast("long"))
    return F.call_function("div", tf * F.expr("1000000000L"), tf * 1000 + m * 12)


def bound_scores(block: list[tuple[np.ndarray, np.ndarray]], most: dict[int, int], least: list[int], top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function over (row_id, term, impact) sorted by row_id: documents that may be among an item's ``top``, with bounds.

    ``block`` has (terms, weights) of each item, ``most`` a term's highest impact, ``least`` the score
    that each item's results reach at the least. What is below an item's threshold is not used.
    """
    by_term: dict[int, list[tuple[int, int, int, int]]] = {}
    unread = np.zeros(len(block), np.int64)
    for i, (terms, weights) in enumerate(block):
        line = max(1, least[i] // max(len(terms), 1))
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            rest = min(line - 1, w * most[t])
            unread[i] += rest
            by_term.setdefault(t, []).append((i, w, -(-line // w), rest))
    floor = np.maximum(np.array(least, np.int64), 1)

    def bounded_rows(rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, at = np.unique(rows, return_inverse=True)
        low = np.zeros((len(block), len(ids)), np.int64)
        seen = np.zeros((len(block), len(ids)), np.int64)
        order = np.argsort(terms, kind="stable")
        cuts = np.flatnonzero(np.diff(terms[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            doc, imp = at[part], impacts[part]
            for i, w, line, rest in by_term.get(int(terms[part[0]]), ()):
                read = imp >= line
                low[i, doc[read]] += w * imp[read]
                seen[i, doc[read]] += rest
        high = np.where(low > 0, low + unread[:, None] - seen, 0)
        need = floor
        if len(ids) >= top:
            need = np.maximum(floor, np.partition(low, len(ids) - top, axis=1)[:, len(ids) - top])
        i, j = np.nonzero(high >= need[:, None])
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(ids[j]), pa.array(low[i, j]), pa.array(high[i, j])], names=["item", "row_id", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = max(_CELLS // max(len(block), 1), 1) * 50
        held: list[np.ndarray] = []
        count = 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]))
            count += batch.num_rows
            if count >= min(many, 1_000_000):
                rows = np.concatenate(held, axis=1)
                end = np.searchsorted(rows[0], rows[0, -1])
                yield from cut(rows[:, :end])
                held, count = [rows[:, end:]], rows.shape[1] - end
        if count:
            yield from cut(np.concatenate(held, axis=1))

    def cut(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """As many documents at once as the sums allow."""
        new = np.flatnonzero(np.diff(rows[0], prepend=rows[0, 0] - 1 if rows.shape[1] else 0))
        step = max(_CELLS // max(len(block), 1), 1)
        ends = [*new[::step].tolist(), rows.shape[1]]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield from bounded_rows(*rows[:, a:b])

    return run


def kth(scored: DataFrame, score: str, top: int) -> DataFrame:
    """item, kth: the ``top``-th largest value of each item that has so many."""
    order = Window.partitionBy("item").orderBy(F.desc(score))
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).where(F.col("place") == top).select("item", F.col(score).alias("kth"))


def _search_block(docs: DataFrame, block: list, top: int) -> DataFrame:
    """item (place in the block), row_id, rank, score."""
    spark = docs.sparkSession
    scratch: list[str] = []
    vocabulary = sorted({t["term"] for row in block for t in row["terms"]})
    place = {t: k for k, t in enumerate(vocabulary)}
    held = stored(held_terms(docs, vocabulary), scratch)
    n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
    empty = spark.createDataFrame([], "item int, row_id bigint, rank int, score bigint")
    if not n_docs:
        forget(spark, scratch)
        return empty
    one = held.select("row_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("z"))
    postings = one.select(F.col("z.terms").alias("term"), "row_id", impact(F.col("z.tfs"), F.col("n"), n_docs, n_terms).alias("impact"))
    postings = stored(postings.repartitionByRange("term", F.desc("impact"), "row_id").sortWithinPartitions("term", F.desc("impact"), "row_id"), scratch)
    df = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs + 2)) / (2 * F.col("df") + 1)))
    terms = {r["term"]: (r["weight"], r["most"]) for r in df.select("term", weight.alias("weight"), "most").collect()}
    weighted = []
    for row in block:
        of = [(place[t["term"]], t["times"] * terms[place[t["term"]]][0]) for t in row["terms"] if place[t["term"]] in terms]
        of = [x for x in of if x[1] > 0]
        weighted.append((np.array([t for t, _ in of], np.int64), np.array([w for _, w in of], np.int64)))
    flat = [(i, int(t), int(w)) for i, (ts, ws) in enumerate(weighted) for t, w in zip(ts, ws, strict=True)]
    if not flat:
        forget(spark, scratch)
        return empty
    asked = bounded(stored(spark.createDataFrame(flat, "item int, term int, w bigint"), scratch), BROADCAST_ROWS)
    part = F.sum(F.col("w") * F.col("impact"))

    order = Window.partitionBy("term").orderBy(F.desc("impact"), "row_id")
    heads = postings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    first = heads.join(asked, "term").groupBy("item", "row_id").agg(part.alias("low"))
    reached = {r["item"]: r["kth"] for r in kth(first, "low", top).collect()}
    least = [reached.get(i, 0) for i in range(len(block))]

    lines: dict[int, int] = {}
    for i, (ts, ws) in enumerate(weighted):
        line = max(1, least[i] // max(len(ts), 1))
        for t, w in zip(ts.tolist(), ws.tolist(), strict=True):
            lines[t] = min(lines.get(t, 1 << 62), -(-line // w))
    deep = stored(spark.createDataFrame(list(lines.items()), "term int, line bigint"), scratch)
    read = postings.join(bounded(deep, BROADCAST_ROWS), "term").where("impact >= line").select("row_id", "term", "impact")
    most = {t: m for t, (_, m) in terms.items()}
    bound = read.repartition("row_id").sortWithinPartitions("row_id").mapInArrow(bound_scores(weighted, most, least, top), _BOUNDS)
    bound = stored(bound, scratch)
    line = kth(bound, "low", top).withColumnRenamed("kth", "line")
    few = bound.join(bounded(line, BROADCAST_ROWS), "item", "left").where("high >= greatest(coalesce(line, 1), 1)").select("item", "row_id")
    few = bounded(stored(few, scratch), BROADCAST_ROWS)

    exact = postings.join(few, "row_id").join(asked, ["item", "term"]).groupBy("item", "row_id").agg(part.alias("score"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), "row_id")
    ranked = exact.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    out = stored(ranked.select("item", "row_id", "rank", "score"))
    forget(spark, scratch)
    return out


def search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` highest-scoring documents of each item, equal scores by ascending doc_id."""
    base = numbered(docs.select("doc_id", "text"))
    asked = numbered(items.select("item_id", "text"), "item_id")
    wanted = stored(item_terms(asked))
    found = None
    for block in _blocks(wanted):
        names = stored(docs.sparkSession.createDataFrame([(i, r["row_id"]) for i, r in enumerate(block)], "item int, item_row bigint"))
        part = _search_block(base, block, top).join(bounded(names, BROADCAST_ROWS), "item").select("item_row", "row_id", "rank", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_row bigint, row_id bigint, rank int, score bigint")
    named = base.select("row_id", "doc_id").join(bounded(found, BROADCAST_ROWS), "row_id")
    return named.join(bounded(asked.select(F.col("row_id").alias("item_row"), "item_id"), BROADCAST_ROWS), "item_row").select("item_id", "rank", "doc_id", "score")
