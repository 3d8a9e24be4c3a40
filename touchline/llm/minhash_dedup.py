"""MinHash near-dedup with tensored banding.

Two collections of m half keys, each of r minhashes, are computed for every set of word shingles;
the m * m table keys are all pairs of a half key from either collection. Thus m * m tables of 2 * r
rows cost 2 * m * r minhashes instead of 2 * m * m * r.

Texts with the same set form a class and only the classes' first members are compared. In each table
bucket the members are first paired with the bucket's smallest member, and verified on full sets. Buckets that then
still hold more than one component are searched again between the components only, the rows outside a
bucket's largest component against all of its rows, so a bucket of thousands of near copies never gives all its
pairs, and no link between components is left untested. A pair is met once, in the first of the tables that it shares.
Before full sets are compared, sizes and parity bitmaps are asked whether they leave room for a link: a
bitmap never differs in more positions than the sets differ in shingles, so no link is lost to it. Sets
of more than ``WHOLE`` shingles have no bitmap; theirs are all compared whole.

Table keys are made in passes over the first collection, and only keys that two rows share are kept.

Hot buckets are reduced by partial aggregation before the shuffle, and joins on bucket keys can be
split by adaptive execution. Components are found in Spark; nothing is collected.

Defined results: a null, empty or blank text has an empty set and links with nothing; a text with
fewer than ``width`` words is one shingle of all its words; repeated ids are rows of their own (the
one that comes first is kept); an empty table gives an empty result; other columns are ignored or
carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded, bytes_of, forget, numbered, release, sliced, stored
from .components import connected_components

_U = np.uint64


@dataclass(frozen=True)
class Banding:
    """m half keys of r minhashes in each of two collections: m * m tables of 2 * r rows.

    With r = 3 and m = 15 a pair at the threshold 0.75 is found with probability 0.9995, and one at
    0.3 shares a bucket with probability 0.11.
    """

    m: int = 15
    r: int = 3
    width: int = 5
    percent: int = 75


#: Candidate ids, of 8 bytes each, are broadcast to the texts only up to so many.
CANDIDATES = 500_000
#: Rounds of one leader for each member, and passes in which table keys are made.
STAR_TURNS, PASSES = 2, 3
#: Longs of a parity bitmap, and the largest set that it takes whole.
BIT_WORDS, WHOLE = 16, 512


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    x = K.mix(np.arange(1, 2 * count + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return x[:count] | _U(1), x[count:]


def shingle_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, document) of the distinct shingles of a batch's texts, and the set sizes."""
    data, offsets = bytes_of(batch.column("text"))
    data = K.lowered(data)
    starts, ends, docs = K.space_words(data, offsets)
    words = K.run_hashes(K.prefix_sums(data), starts, ends) if len(starts) else np.zeros(0, _U)
    values, owners = K.distinct_per_doc(*K.shingles(words, docs, batch.num_rows, width))
    return values, owners, np.bincount(owners, minlength=batch.num_rows)


def _sketch(banding: Banding):
    count = 2 * banding.m * banding.r
    factor, offset = _multipliers(count)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values, owners, sizes = shingle_sets(batch, banding.width)
        n = batch.num_rows
        some = np.flatnonzero(sizes)
        first = (np.cumsum(sizes) - sizes)[some]
        least = np.zeros((n, count), _U)
        sums = np.zeros((2, n), _U)
        if len(some):
            for k in range(count):
                least[some, k] = np.minimum.reduceat((values ^ offset[k]) * factor[k], first)
            sums[0, some] = np.add.reduceat(values * _U(0xD6E8FEB86659FD93), first)
            sums[1, some] = np.add.reduceat(K.mix(values + _U(3)), first)
        least = K.mix(least)
        halves = least.reshape(n, 2, banding.m, banding.r)
        keys = np.zeros(halves.shape[:3], _U)
        for j in range(banding.r):
            keys = keys * _U(0x9FB21C651E98DF25) + halves[..., j]
        keys = K.mix(keys + np.arange(1, 2 * banding.m + 1, dtype=_U).reshape(2, banding.m) * _U(0xA24BAED4963EE407))
        lists = lambda x: pa.ListArray.from_arrays(np.arange(0, n * banding.m + 1, banding.m, dtype=np.int32), pa.array(x.reshape(-1).view(np.int64)))
        mixed = K.mix(values + _U(11))
        taken = (sizes <= WHOLE)[owners]
        odd = np.zeros((n, BIT_WORDS), _U)
        np.bitwise_xor.at(odd, (owners[taken], ((mixed[taken] >> _U(6)) % _U(BIT_WORDS)).astype(np.int64)), _U(1) << (mixed[taken] & _U(63)))
        bits = pa.ListArray.from_arrays(np.arange(0, n * BIT_WORDS + 1, BIT_WORDS, dtype=np.int32), pa.array(odd.reshape(-1).view(np.int64)))
        yield pa.record_batch(
            {"row_id": batch.column("row_id"), "n": pa.array(sizes.astype(np.int64)), "s0": pa.array(sums[0].view(np.int64)), "s1": pa.array(sums[1].view(np.int64)),
             "left": lists(np.ascontiguousarray(keys[:, 0])), "right": lists(np.ascontiguousarray(keys[:, 1])),
             "bits": bits}
        )

    return fn


def _room(percent: int) -> Column:
    """Whether sizes and bitmaps of x and y leave room for a link."""
    n, m = F.col("x.n"), F.col("y.n")
    differ = sum((F.bit_count(F.get("x.bits", F.lit(i)).bitwiseXOR(F.get("y.bits", F.lit(i)))) for i in range(BIT_WORDS)), F.lit(0))
    most = n + m - 2 * F.ceil(percent * (n + m) / (100 + percent))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((F.greatest(n, m) > WHOLE) | (differ <= most))


def _full_sets(width: int):
    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values, _, sizes = shingle_sets(batch, width)
        ends = np.concatenate([[0], np.cumsum(sizes)]) * 8
        data = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])
        yield pa.record_batch({"row_id": batch.column("row_id"), "shingles": data})

    return fn


def _verify(percent: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("shingles_a"), batch.column("shingles_b")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), _U) for c in (a, b))
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.record_batch({c: batch.column(c).filter(pa.array(keep)) for c in ("a", "b")})

    return fn


def _verified(docs: DataFrame, sketches: DataFrame, pairs: DataFrame, banding: Banding) -> DataFrame:
    """The pairs (a, b) that are links, confirmed on the full sets of both."""
    spark = docs.sparkSession
    short = sketches.select(F.col("row_id").alias("id"), "n", "bits")
    both = pairs.join(short.alias("x"), F.expr("a = x.id")).join(short.alias("y"), F.expr("b = y.id"))
    likely = stored(both.where(_room(banding.percent)).select("a", "b"))
    release(spark)
    ids = stored(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = docs.select("row_id", "text").join(bounded(ids, CANDIDATES), F.expr("row_id = id"), "left_semi")
    sets = stored(texts.mapInArrow(sliced(_full_sets(banding.width)), "row_id long, shingles binary"))
    release(spark)
    of = lambda x: sets.select(F.col("row_id").alias(f"id_{x}"), F.col("shingles").alias(f"shingles_{x}"))
    full = likely.join(of("b"), F.expr("b = id_b")).select("a", "b", "shingles_b").join(of("a"), F.expr("a = id_a"))
    links = stored(full.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_verify(banding.percent), "a long, b long"))
    release(spark)
    return links


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose members are not in one component yet."""
    of = lambda x: found.select(F.col("node").alias(f"n{x}"), F.col("component").alias(f"c{x}"))
    placed = pairs.join(of("a"), F.expr("a = na"), "left").join(of("b"), F.expr("b = nb"), "left")
    return placed.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _members(firsts: DataFrame, banding: Banding, gone: list[str]) -> DataFrame:
    """key, row_id, a of every row in every table bucket that holds more than one; a is the bucket's smallest row."""
    found = None
    for k in range(PASSES):
        begin, end = banding.m * k // PASSES, banding.m * (k + 1) // PASSES
        halves = firsts.select("row_id", F.explode(F.slice("left", begin + 1, end - begin)).alias("half"), "right")
        here: list[str] = []
        shared = stored(halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select(F.col("half").alias("h")), here)
        release(firsts.sparkSession)
        met = stored(halves.join(shared, F.expr("half = h"), "left_semi"), here)
        release(firsts.sparkSession)
        keys = met.select("row_id", F.explode(F.transform("right", lambda x: F.xxhash64("half", x))).alias("key"))
        buckets = stored(keys.groupBy("key").agg(F.min("row_id").alias("a"), F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("k"), "a"), here)
        release(firsts.sparkSession)
        part = stored(keys.join(buckets, F.expr("key = k")).select("key", "row_id", "a"), gone)
        forget(firsts.sparkSession, here)
        release(firsts.sparkSession)
        found = part if found is None else found.unionByName(part)
    return found


def _first_table() -> Column:
    """The key of the first table that x and y share; halves are equal only where they stand at the same place."""
    common = lambda side: F.get(F.array_compact(F.zip_with(f"x.{side}", f"y.{side}", lambda a, b: F.when(a == b, a))), F.lit(0))
    return F.xxhash64(common("left"), common("right"))


def _across(members: DataFrame, found: DataFrame, sketches: DataFrame, banding: Banding, gone: list[str]) -> DataFrame:
    """Pairs (a, b) of one bucket and different components whose sizes and bitmaps leave room for a link, each in its first bucket only."""
    at = found.select("node", "component")
    labelled = stored(members.join(at, F.expr("row_id = node"), "left").select("key", "row_id", F.coalesce("component", "row_id").alias("component")), gone)
    per = labelled.groupBy("key", "component").agg(F.count("*").alias("c"))
    several = per.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), "main")
    open_ = stored(labelled.join(stored(several, gone), F.expr("key = k")).select("key", "row_id", "component", (F.col("component") == F.col("main")).alias("main")), gone)
    release(members.sparkSession)
    short = sketches.select(F.col("row_id").alias("id"), "n", "bits", "left", "right")
    rows = open_.join(short, F.expr("row_id = id")).drop("id")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & (F.col("y.main") | (F.col("x.row_id") < F.col("y.row_id")))
    met = rows.where("not main").alias("x").join(rows.alias("y"), apart & _room(banding.percent) & (F.col("x.key") == _first_table()))
    return stored(met.select(F.least("x.row_id", "y.row_id").alias("a"), F.greatest("x.row_id", "y.row_id").alias("b")), gone)


def near_duplicates(docs: DataFrame, banding: Banding | None = None, carry: list[str] | None = None) -> DataFrame:
    """doc_id (or ``carry``), n_shingles, component_id, kept for every document.

    Documents link where 100 * intersection >= percent * union of their shingle sets; component_id is
    the smallest doc_id that is reachable; kept marks the first document of each component.
    """
    banding = banding or Banding()
    carry = carry or ["doc_id"]
    base = numbered(docs.select("doc_id", "text", F.struct(*carry).alias("row")))
    sketches = stored(
        base.select("row_id", "text").mapInArrow(
            sliced(_sketch(banding)), "row_id long, n long, s0 long, s1 long, left array<long>, right array<long>, bits array<long>"
        )
    )
    classes = stored(sketches.where("n > 0").groupBy("n", "s0", "s1").agg(F.min("row_id").alias("first")))
    firsts = stored(sketches.join(classes.select(F.col("first").alias("row_id")), "row_id", "left_semi"))
    gone: list[str] = []
    release(docs.sparkSession)
    members = _members(firsts, banding, gone)
    star = stored(members.where("row_id <> a").select("a", F.col("row_id").alias("b")).distinct(), gone)
    release(docs.sparkSession)
    links = found = None
    for _ in range(STAR_TURNS):  # one leader for each member at a time: most groups are whole after the first
        here = star if found is None else _apart(star, found)
        here = stored(here.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), gone)
        if here.isEmpty():
            break
        fresh = _verified(base, sketches, here, banding)
        star = stored(star.join(here, ["a", "b"], "left_anti"), gone)
        links = fresh if links is None else links.unionByName(fresh)
        found = stored(connected_components(links))
    if found is None:
        links = star
        found = stored(connected_components(links))
    more = _across(members, found, sketches, banding, gone)
    if not more.isEmpty():  # afterwards every pair of a bucket was tested or lies within one component
        links = links.unionByName(_verified(base, sketches, more, banding))
        found = stored(connected_components(links))
    member = sketches.select("row_id", F.col("n").alias("n_shingles"), "n", "s0", "s1")
    of_class = classes.select(F.col("n").alias("cn"), F.col("s0").alias("c0"), F.col("s1").alias("c1"), "first")
    placed = member.join(of_class, F.expr("n = cn and s0 = c0 and s1 = c1"), "left").join(found, F.expr("first = node"), "left")
    placed = stored(placed.select(F.col("row_id").alias("id"), "n_shingles", F.coalesce("component", "first", "row_id").alias("component_row")))
    forget(docs.sparkSession, gone)
    release(docs.sparkSession)
    rows = base.select("row_id", "row", "doc_id").join(placed, F.expr("row_id = id"))
    kept = F.col("row_id") == F.col("component_row")
    if dict(docs.dtypes)["doc_id"] == "bigint" and base.where("not (row_id <=> doc_id)").isEmpty():
        return rows.select("row.*", "n_shingles", F.col("component_row").alias("component_id"), kept.alias("kept"))
    names = base.select(F.col("row_id").alias("name_row"), F.col("doc_id").alias("component_id"))
    return rows.join(names, F.expr("component_row = name_row")).select("row.*", "n_shingles", "component_id", kept.alias("kept"))
