"""Source divergence audit by joint count histograms.

For every pair of sources of a language the distinct (count, count) combinations of its terms are
tallied; the measure is evaluated once for each combination and multiplied by how many terms have
it. Cells with a zero are implied: what a source's own histogram of counts holds beyond the tallied
pairs, and what the vocabulary holds beyond both.

Terms are counted in numpy slices of whole texts and summed per task before the one shuffle by
(language, term); each task then tallies the pairs of its own terms, so no row for a single term and
pair of sources is ever shuffled. Shares are whole numbers of billionths; all arithmetic is exact.

Defined results: null text, language or source are ''; rows with equal ids are documents of their
own; a language without kept terms has pair values of 0 and no term rows; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, bytes_of, forget, sliced, stored
from .kernels import lowered

BROADCAST_ROWS = 200_000
#: Counted terms that a task gathers before it sums and passes them on.
_GATHERED = 400_000
_SLICE = 4 << 20
_ROWS = 200_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_COUNTED = "lang string, source string, term string, n bigint, df bigint"
_TALLIED = "lang string, a string, b string, ca bigint, cb bigint, m bigint"


def term_array(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _LETTER) -> tuple[pa.StringArray, np.ndarray]:
    """(terms, text of each): the maximal runs of the bytes marked in ``inside``, A-Z lower-cased."""
    keep = inside[data]
    before = np.zeros(len(keep), bool)
    before[1:] = keep[:-1]
    begin = np.zeros(len(keep) + 1, bool)
    begin[offsets] = True
    starts = np.flatnonzero(keep & (~before | begin[: len(keep)]))
    kept = np.concatenate([[0], np.cumsum(keep)])
    ends = np.append(kept[starts], kept[-1])
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(lowered(data[keep])))
    return terms, np.searchsorted(offsets, starts, side="right") - 1


def term_counts(terms: pa.StringArray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """(text, code, count, dictionary): each distinct term of each text with its occurrences."""
    coded = terms.dictionary_encode()
    width = max(len(coded.dictionary), 1)
    key, n = np.unique(docs * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return key // width, key % width, n, coded.dictionary


def _count_slice(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    groups = pa.table({"lang": batch.column("lang"), "source": batch.column("source")})
    pairs = groups.group_by(["lang", "source"], use_threads=False).aggregate([])
    known = {k: i for i, k in enumerate(zip(pairs["lang"].to_pylist(), pairs["source"].to_pylist(), strict=True))}
    group = np.array([known[k] for k in zip(groups["lang"].to_pylist(), groups["source"].to_pylist(), strict=True)], np.int64)
    doc, code, n, names = term_counts(*term_array(*bytes_of(batch.column("text"))))
    width = max(len(names), 1)
    key, at = np.unique(group[doc] * width + code, return_inverse=True)
    if len(key):
        which = pairs.take(pa.array(key // width))
        total = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
        yield pa.table([which["lang"], which["source"], names.take(pa.array(key % width)), pa.array(total), pa.array(np.bincount(at, minlength=len(key)))], names=["lang", "source", "term", "n", "df"])


def _summed(held: list[pa.Table]) -> pa.Table:
    got = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("df", "sum")])
    return got.select(["lang", "source", "term", "n_sum", "df_sum"]).rename_columns(["lang", "source", "term", "n", "df"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for part in sliced(_count_slice, limit=_SLICE)(batches):
        held.append(part)
        rows += len(part)
        if rows > _GATHERED:
            held = [_summed(held)]
            rows = len(held[0])
            if rows > _GATHERED // 2:
                yield from held[0].to_batches(max_chunksize=20_000)
                held, rows = [], 0
    if held:
        yield from _summed(held).to_batches(max_chunksize=20_000)


def counted_terms(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """lang, source, term, n, lang_n for the terms that at least ``least_docs`` documents of the language hold; one shuffle."""
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    dealt = texts.mapInArrow(_count, _COUNTED).repartition("lang", "term")
    per = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    whole = Window.partitionBy("lang", "term")
    summed = per.withColumn("lang_n", F.sum("n").over(whole)).withColumn("lang_df", F.sum("df").over(whole))
    return summed.where(F.col("lang_df") >= least_docs).select("lang", "source", "term", "n", "lang_n")


def _added(held: list[pa.Table]) -> pa.Table:
    keys = ["lang", "a", "b", "ca", "cb"]
    got = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("m", "sum")])
    return got.select([*keys, "m_sum"]).rename_columns([*keys, "m"])


def _pairs(rows: pa.Table) -> Iterator[pa.Table]:
    """The tallied combinations of neighbours in rows sorted by language, term and source: first all that stand one apart, then two, ..."""
    def codes(name: str) -> tuple[np.ndarray, pa.Array]:
        coded = rows[name].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    (lang, langs), (term, _), (source, sources) = codes("lang"), codes("term"), codes("source")
    n = rows["n"].to_numpy()
    left = np.arange(len(n))
    step = 0
    while True:
        step += 1
        left = left[left + step < len(n)]
        left = left[(term[left] == term[left + step]) & (lang[left] == lang[left + step])]
        if not len(left):
            return
        right = left + step
        keys = pa.table({"lang": lang[left], "a": source[left], "b": source[right], "ca": n[left], "cb": n[right], "m": np.ones(len(left), np.int64)})
        got = _added([keys])
        yield got.set_column(0, "lang", langs.take(got["lang"])).set_column(1, "a", sources.take(got["a"])).set_column(2, "b", sources.take(got["b"]))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tallies of sorted rows; the last term of a part waits for the rows that may follow."""
    waiting: list[pa.RecordBatch] = []
    held: list[pa.Table] = []
    count = tallied = 0

    def whole(last: bool) -> Iterator[pa.Table]:
        nonlocal waiting, count
        rows = pa.Table.from_batches(waiting)
        end = len(rows)
        if not last:
            term, lang = rows["term"], rows["lang"]
            while end and term[end - 1] == term[len(rows) - 1] and lang[end - 1] == lang[len(rows) - 1]:
                end -= 1
        yield from _pairs(rows.slice(0, end))
        waiting = rows.slice(end).to_batches()
        count = len(rows) - end

    def parts() -> Iterator[pa.Table]:
        nonlocal count
        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= _ROWS:
                yield from whole(False)
        if count:
            yield from whole(True)

    for part in parts():
        held.append(part)
        tallied += len(part)
        if tallied > _GATHERED:
            held = [_added(held)]
            tallied = len(held[0])
            if tallied > _GATHERED // 2:
                yield from held[0].to_batches(max_chunksize=20_000)
                held, tallied = [], 0
    if held:
        yield from _added(held).to_batches(max_chunksize=20_000)


def share(count: Column, total: Column, width: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * width)), by decimals where a long would not hold the product."""
    by = total + 2 * width
    small = F.expr("1000000000L") * (count + 2)
    wide = (count + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    quotient = F.when(count < 9_000_000_000, F.call_function("div", small, by)).otherwise(F.call_function("div", wide, by.cast("decimal(20,0)")))
    return 1 + quotient


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank for every occurring (lang, source).

    ``pair`` ranks the other sources of the language by their distance, summed over its kept terms;
    ``term`` ranks the ``top`` terms that the source uses more than its language does.
    """
    spark = docs.sparkSession
    groups = stored(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct())
    counts = stored(counted_terms(docs, least_docs))
    langs = counts.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_total"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    zero = F.lit(0).cast("long")
    named = groups.join(langs, "lang", "left").join(own, ["lang", "source"], "left").select(
        "lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("v", "lang_total", "total", "held"))
    )
    stats = stored(named)
    known = bounded(stats, BROADCAST_ROWS)

    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = counts.join(known, ["lang", "source"]).withColumn("p", p).withColumn("q", q).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)

    scratch: list[str] = []
    dealt = counts.select("lang", "term", "source", "n").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    joint = stored(dealt.mapInArrow(_tally, _TALLIED).groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")), scratch)
    pairs = stats.select("lang", "v", F.col("source").alias("a"), F.col("total").alias("total_a"), F.col("held").alias("held_a")).join(
        stats.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"), F.col("held").alias("held_b")), "lang"
    ).where("a < b")
    pairs = bounded(stored(pairs), BROADCAST_ROWS)
    histogram = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    histogram = stored(histogram, scratch)
    both = joint.select("lang", "a", "b", "ca", "cb", "m")
    alone_a = pairs.join(histogram.select("lang", F.col("source").alias("a"), F.col("n").alias("ca"), "m"), ["lang", "a"]).select("lang", "a", "b", "ca", zero.alias("cb"), "m")
    alone_b = pairs.join(histogram.select("lang", F.col("source").alias("b"), F.col("n").alias("cb"), "m"), ["lang", "b"]).select("lang", "a", "b", zero.alias("ca"), "cb", "m")
    met_a = joint.groupBy("lang", "a", "b", "ca").agg((-F.sum("m")).alias("m")).select("lang", "a", "b", "ca", zero.alias("cb"), "m")
    met_b = joint.groupBy("lang", "a", "b", "cb").agg((-F.sum("m")).alias("m")).select("lang", "a", "b", zero.alias("ca"), "cb", "m")
    met = joint.groupBy("lang", "a", "b").agg(F.sum("m").alias("m"))
    neither = pairs.join(met, ["lang", "a", "b"], "left").select(
        "lang", "a", "b", zero.alias("ca"), zero.alias("cb"), (F.col("v") - F.col("held_a") - F.col("held_b") + F.coalesce("m", zero)).alias("m")
    )
    keys = ["lang", "a", "b", "ca", "cb"]
    edges = alone_a.unionByName(alone_b).unionByName(met_a).unionByName(met_b).groupBy(*keys).agg(F.sum("m").alias("m"))
    cells = both.unionByName(edges).unionByName(neither).where("m > 0").join(pairs, ["lang", "a", "b"])
    f = distance(share(F.col("ca"), F.col("total_a"), F.col("v")), share(F.col("cb"), F.col("total_b"), F.col("v")))
    summed = cells.groupBy("lang", "a", "b").agg(F.sum(f * F.col("m")).alias("value"))
    valued = stored(pairs.select("lang", "a", "b").join(summed, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", zero)))
    forget(spark, scratch)
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    ranked = valued.select("lang", "value", F.explode(ways).alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    ranked = ranked.withColumn("rank", F.row_number().over(first))
    return ranked.unionByName(terms)
