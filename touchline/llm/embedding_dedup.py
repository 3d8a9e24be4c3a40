"""Embedding near-dedup: random-hyperplane sign hashing, exact cosines, connected components.

Equal vectors form a class and only the classes' first members go on. In each of several tables the
signs of a few random projections name a bucket; the members of a bucket are compared by one matrix
product in double precision. A pair is counted only in the first table whose bucket holds both, so
counts of links add up over tables without a table of pairs. A bucket gives its members' link counts
and, for the components, a star for each group of linked members, never all pairs.

A bucket with more than ``block`` members is cut into blocks and every pair of blocks is a unit of
work of its own, so a hot bucket spreads over the cluster. Vectors travel as they are stored, and
tables are worked through a few at a time, so the shuffle holds that many copies of them and no more.

Defined results: a vector that is null, empty, zero or has null or non-finite components links with
nothing; vectors of different lengths never link; rows with equal or null vec_id are vectors of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, numbered, release, stored
from .components import connected_components


@dataclass(frozen=True)
class Hyperplanes:
    """With 12 signs in 24 tables a pair of cosine 0.95 is found with probability 0.9996."""

    tables: int = 24
    signs: int = 12
    seed: int = 11
    threshold: float = 0.95
    block: int = 512
    #: Tables whose buckets are compared in one pass.
    at_once: int = 3

    def found(self) -> float:
        """The probability that a pair at the threshold shares a bucket: a sign agrees with probability 1 - angle / pi."""
        same = (1 - math.acos(self.threshold) / math.pi) ** self.signs
        return 1 - (1 - same) ** self.tables

    def for_classes(self, n: int) -> Hyperplanes:
        """As many signs as hold a bucket of ``n`` vectors without near copies to about ``block``, and as many tables as hold ``found``.

        Work and shuffle then grow as n to the power 1 + log(1 / p) / log 2, p a sign's agreement: 1.15 for 0.95.
        """
        signs = max(self.signs, math.ceil(math.log2(max(n, 1) / self.block)))
        same = (1 - math.acos(self.threshold) / math.pi) ** signs
        tables = max(self.tables, math.ceil(math.log(1 - self.found()) / math.log(1 - same)))
        return replace(self, signs=signs, tables=-(-tables // self.at_once) * self.at_once)


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components are lost
    return x / np.sqrt((x * x).sum(1))[:, None]


def _signatures(spec: Hyperplanes):
    """Each vector's bucket in each table, as whole numbers of ``signs`` bits."""
    planes: dict[int, np.ndarray] = {}

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(spec.signs)
        for whole in batches:
            sizes = whole.column("dim").to_numpy()
            for dim in np.unique(sizes):
                batch = whole.filter(pa.array(sizes == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng(spec.seed).standard_normal((int(dim), spec.tables * spec.signs))
                signs = (_unit(batch.column("vector"), int(dim)) @ planes[dim] > 0).reshape(-1, spec.tables, spec.signs)
                codes = (signs * weights).sum(2).astype(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, spec.tables, dtype=np.int32), pa.array(codes.reshape(-1)))
                yield pa.record_batch({**{c: batch.column(c) for c in ("row_id", "n", "dim", "vector")}, "codes": lists})

    return fn


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each unit of work, from a partition that is sorted by unit."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        unit = batch.column("unit").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(unit[1:] != unit[:-1]) + 1, [len(unit)]])
        for k in range(len(edges) - 1):
            part = batch.slice(edges[k], edges[k + 1] - edges[k])
            if held and held[0].column("unit")[0] != part.column("unit")[0]:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
            held.append(part)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _compare(spec: Hyperplanes):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            dim, at = group.column("dim")[0].as_py(), group.column("at")[0].as_py()
            x = _unit(group.column("vector"), dim)
            codes = group.column("codes").flatten().to_numpy().reshape(-1, spec.tables)
            ids, n, side = (group.column(c).to_numpy() for c in ("row_id", "n", "side"))
            left = np.flatnonzero(side != 1)
            right = np.flatnonzero(side != 0)
            i, j = np.nonzero(x[left] @ x[right].T >= spec.threshold)
            i, j = left[i], right[j]
            ok = (ids[i] < ids[j]) | ((side[i] == 0) & (side[j] == 1))
            i, j = i[ok], j[ok]
            if at and len(i):
                new = ~(codes[i, :at] == codes[j, :at]).any(1)
                i, j = i[new], j[new]
            if not len(i):
                continue
            links = np.bincount(i, weights=n[j], minlength=len(ids)) + np.bincount(j, weights=n[i], minlength=len(ids))
            end = ids.copy()
            while True:  # the smallest id that a member reaches inside the unit
                low = end.copy()
                np.minimum.at(low, i, end[j])
                np.minimum.at(low, j, end[i])
                if (low == end).all():
                    break
                end = low
            has = np.flatnonzero(links)
            out.append((ids[has], links[has].astype(np.int64), end[has]))
            if len(out) >= 500:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return fn


def _batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.record_batch({name: pa.array(np.concatenate([p[k] for p in parts])) for k, name in enumerate(("row_id", "links", "end"))})


def usable(column: str) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _compared(hashed: DataFrame, spec: Hyperplanes, begin: int) -> DataFrame:
    """row_id, end, links: link counts and stars from the buckets of the tables from ``begin`` on."""
    codes = F.posexplode(F.slice("codes", begin + 1, spec.at_once)).alias("step", "code")
    keyed = hashed.select("row_id", "dim", codes).select("row_id", "dim", "code", (F.col("step") + begin).alias("at"))
    counts = keyed.groupBy("dim", "at", "code").agg(F.count("*").alias("m")).where("m > 1")
    gone: list[str] = []
    blocks = stored(counts.select(*(F.col(c).alias(f"k_{c}") for c in ("dim", "at", "code")), F.ceil(F.col("m") / spec.block).alias("blocks")), gone)
    work = keyed.join(blocks, F.expr("dim = k_dim and at = k_at and code = k_code")).withColumn("own", F.pmod(F.xxhash64("row_id"), F.col("blocks")))
    pairs = work.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = pairs.select(
        "row_id", "at", F.xxhash64("dim", "at", "code", F.least("own", "with"), F.greatest("own", "with")).alias("unit"),
        F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1).alias("side"),
    )
    body = hashed.select(F.col("row_id").alias("id"), "n", "dim", "vector", "codes")
    full = units.join(body, F.expr("row_id = id")).select("row_id", "n", "dim", "vector", "codes", "at", "side", "unit")
    compared = full.repartition("unit").sortWithinPartitions("unit").mapInArrow(_compare(spec), "row_id long, links long, end long")
    found = stored(compared.groupBy("row_id", "end").agg(F.sum("links").alias("links")))
    forget(hashed.sparkSession, gone)
    release(hashed.sparkSession)
    return found


def near_duplicates(vectors: DataFrame, spec: Hyperplanes | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding); ``spec`` follows the number of different vectors."""
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    base = numbered(vectors.select("vec_id", "embedding"), "vec_id")
    ok = base.where(usable("embedding")).select("row_id", "embedding")
    classes = stored(ok.groupBy("embedding").agg(F.min("row_id").alias("first"), F.count("*").alias("n")))
    spec = spec or Hyperplanes().for_classes(classes.count())
    whole = classes.select(F.col("first").alias("row_id"), "n", F.size("embedding").alias("dim"), F.col("embedding").cast(kind).alias("vector"))
    hashed = stored(whole.mapInArrow(_signatures(spec), f"row_id long, n long, dim int, vector {kind}, codes array<bigint>"))
    parts = [_compared(hashed, spec, begin) for begin in range(0, spec.tables, spec.at_once)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = stored(found.groupBy("row_id", "end").agg(F.sum("links").alias("links")))
    release(vectors.sparkSession)
    links = found.groupBy("row_id").agg(F.sum("links").alias("links")).select(F.col("row_id").alias("linked"), "links")
    components = connected_components(found, "row_id", "end")
    first = classes.select(F.col("embedding").alias("e"), "first", "n")
    of_row = ok.join(first, F.expr("embedding = e")).select(F.col("row_id").alias("r"), "first", "n")
    of_row = of_row.join(links, F.expr("first = linked"), "left").join(components, F.expr("first = node"), "left")
    of_row = stored(
        of_row.select("r", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_row"))
    )
    rows = base.select("row_id", "vec_id").join(of_row, F.expr("row_id = r"), "left").withColumn("c", F.coalesce("component_row", "row_id"))
    kept = (F.col("row_id") == F.col("c")).alias("kept")
    n_links = F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    if dict(vectors.dtypes)["vec_id"] == "bigint" and base.where("not (row_id <=> vec_id)").isEmpty():
        return rows.select("vec_id", n_links, F.col("c").alias("component_id"), kept)
    names = base.select(F.col("row_id").alias("name_row"), F.col("vec_id").alias("component_id"))
    return rows.join(names, F.expr("c = name_row")).select("vec_id", n_links, "component_id", kept)
