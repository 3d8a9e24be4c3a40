"""Tracklet operators: votes, filters, merging, teams, sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def weighted_vote(rows: DataFrame, track: str, value: str, weight: str, pos: str) -> DataFrame:
    """Per track the value of the largest summed weight; the first seen wins a tie; null is a value."""
    sums = rows.groupBy(track, value).agg(F.sum(weight).alias("__sum"), F.min(pos).alias("__first"))
    rank = F.struct(F.col("__sum"), -F.col("__first"))
    return sums.groupBy(track).agg(F.max_by(value, rank).alias(value), F.max("__sum").alias("weight"))


def vote_all(rows: DataFrame, track: str, attributes: dict[str, str], pos: str) -> DataFrame:
    """The vote for every attribute (value column to weight column) in one pass over the rows."""
    long = None
    for value, weight in attributes.items():
        part = rows.select(F.col(track), F.lit(value).alias("__a"), F.col(value).cast("string").alias("__v"), F.col(weight).alias("__w"), F.col(pos))
        long = part if long is None else long.unionByName(part)
    sums = long.groupBy(track, "__a", "__v").agg(F.sum("__w").alias("__sum"), F.min(pos).alias("__first"))
    best = sums.groupBy(track, "__a").agg(F.max_by("__v", F.struct(F.col("__sum"), -F.col("__first"))).alias("__v"))
    return best.groupBy(track).pivot("__a", list(attributes)).agg(F.first("__v"))


def broadcast_vote(rows: DataFrame, voted: DataFrame, track: str, value: str) -> DataFrame:
    """The voted value on every row of its track."""
    return rows.drop(value).join(voted.select(track, value), track, "left")


def neighbour_supported(rows: DataFrame, track: str, value: str, order: list[str]) -> DataFrame:
    """Rows whose value also stands on the row before or after it in its track."""
    w = Window.partitionBy(track).orderBy(*order)
    near = (F.lag(value).over(w) == F.col(value)) | (F.lead(value).over(w) == F.col(value))
    return rows.withColumn("__k", F.coalesce(near, F.lit(False))).where("__k").drop("__k")


def mean_vector(rows: DataFrame, track: str, vector: str, length: int) -> DataFrame:
    """Element-wise mean over vectors of the right length with finite components; none gives null."""
    v = F.col(vector)
    good = (F.size(v) == length) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sums = [F.avg(F.when(good, v[i].cast("double"))).alias(f"m{i}") for i in range(length)]
    means = rows.groupBy(track).agg(*sums)
    return means.select(track, F.when(F.col("m0").isNotNull(), F.array(*(f"m{i}" for i in range(length)))).alias("mean"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, not below 0; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.greatest(F.lit(0.0), 1 - F.when(norm > 0, dot(a, b) / norm))


def two_clusters(means: DataFrame, track: str, seed: int = 0) -> DataFrame:
    """K-means with two clusters of tracklet means; labels in order of the centres' first component.

    One tracklet gets 0; tracklets without a mean get null.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    known = means.where(F.col("mean").isNotNull()).select(track, array_to_vector("mean").alias("features"))
    n = known.select(track).limit(2).count()
    if n < 2:
        return means.select(track, F.when(F.col("mean").isNotNull(), 0).alias("cluster"))
    model = KMeans(k=2, seed=seed, maxIter=50).fit(known)
    order = np.argsort([tuple(c)[0] for c in model.clusterCenters()], kind="stable")
    rank = F.create_map(*(F.lit(int(x)) for pair in ((old, new) for new, old in enumerate(order)) for x in pair))
    labels = model.transform(known).select(track, rank[F.col("prediction")].alias("cluster"))
    return means.select(track).join(labels, track, "left")


def team_sides(rows: DataFrame, cluster: str, x: str, role: str) -> DataFrame:
    """The cluster of larger mean x is right, the other left; goalkeepers go by the sign of their x."""
    real = F.when(~F.isnan(F.col(x)), F.col(x))
    means = rows.groupBy().agg(*(F.avg(F.when(F.col(cluster) == k, real)).alias(f"__m{k}") for k in (0, 1)))
    left = F.when(F.col("__m0") < F.col("__m1"), 0).otherwise(1)
    side = F.when(F.col(cluster).isNull(), None).when(F.col(cluster) == left, "left").otherwise("right")
    keeper = F.when(F.col(x) > 0, "right").otherwise("left")
    out = F.when((F.col(role) == "goalkeeper") & F.col(x).isNotNull(), keeper).otherwise(side)
    return rows.join(F.broadcast(means)).withColumn("side", out).drop("__m0", "__m1")  # one row of two means


def mode_per_track(rows: DataFrame, track: str, value: str) -> DataFrame:
    """The most frequent value that is not null; the smallest wins a tie."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(track, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(track).orderBy(F.desc("__n"), value)
    return counts.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(track, value, F.col("__n").alias("n"))


def merge_by_mode(rows: DataFrame, track: str, value: str, frame: str, extra: list[str] | None = None) -> DataFrame:
    """Tracks of one mode value become one track unless two of them share a frame.

    Adds ``merged``: dense numbers from 1, merged groups first, in order of value and of track.
    """
    renamed = rows.withColumnRenamed(value, "__value")
    modes = mode_per_track(renamed, track, "__value").select(track, F.col("__value").alias("__mode"))
    seen = rows.select(track, frame).distinct().join(modes, track)
    clash = seen.groupBy("__mode", frame).agg(F.countDistinct(track).alias("n")).where("n > 1").select("__mode").distinct()
    several = modes.groupBy("__mode").agg(F.count("*").alias("n")).where("n > 1").select("__mode")
    whole = several.join(clash, "__mode", "left_anti").withColumn("__merge", F.lit(True))
    tracks = rows.select(track).distinct().join(modes, track, "left").join(whole, "__mode", "left")
    merged = ordered.numbered(tracks.where("__merge").select("__mode").distinct(), ["__mode"], "merged", 1)
    alone = ordered.numbered(tracks.where("__merge is null").select(track), [track], "merged", 1)
    shift = merged.agg(F.coalesce(F.max("merged"), F.lit(0)).alias("__shift"))
    alone = alone.join(F.broadcast(shift)).select(track, (F.col("merged") + F.col("__shift")).alias("merged"))  # one row
    together = tracks.where("__merge").join(merged, "__mode").select(track, "merged")
    return rows.join(together.unionByName(alone), track)


def agglomerate(tracks: DataFrame, group: str, threshold: float) -> DataFrame:
    """Repeatedly merge the closest pair of tracks with cosine distance <= threshold and disjoint frames.

    ``tracks`` has group, track (long), n (long), mean (array<double>), frames (array<long>); a video's
    tracks are few, so each video is one task. Returns group, track, merged (smallest track of the cluster).
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("track")
        items = [([int(t)], np.asarray(m, float), float(n), set(f)) for t, m, n, f in zip(pdf["track"], pdf["mean"], pdf["n"], pdf["frames"], strict=True) if m is not None]
        alone = [int(t) for t, m in zip(pdf["track"], pdf["mean"], strict=True) if m is None]
        x = np.stack([m for _, m, _, _ in items]) if items else np.zeros((0, 1))
        unit = x / np.where((norm := np.linalg.norm(x, axis=1)) == 0, np.inf, norm)[:, None]
        far = np.full((len(items), len(items)), np.inf)  # distances of i < j, infinite where they may not merge

        def measure(i: int, others: np.ndarray) -> None:
            d = np.maximum(0, 1 - unit[others] @ unit[i])
            ok = np.array([items[j] is not None and not items[i][3] & items[j][3] for j in others], bool)
            d[~ok | (d > threshold)] = np.inf
            far[np.minimum(i, others), np.maximum(i, others)] = d

        for i in range(len(items) - 1):
            measure(i, np.arange(i + 1, len(items)))
        while len(items) and np.isfinite(far[(at := np.unravel_index(far.argmin(), far.shape))]):
            i, j = map(int, at)
            (ta, ma, na, fa), (tb, mb, nb, fb) = items[i], items[j]
            mean = (ma * na + mb * nb) / (na + nb)
            items[i], items[j] = (ta + tb, mean, na + nb, fa | fb), None
            length = np.linalg.norm(mean)
            unit[i] = mean / (length if length else np.inf)
            far[j, :] = far[:, j] = np.inf
            measure(i, np.delete(np.arange(len(items)), i))
        items = [one for one in items if one is not None]
        rows = [(t, min(ts)) for ts, *_ in items for t in ts] + [(t, t) for t in alone]
        return pd.DataFrame({group: pdf[group].iloc[0], "track": [a for a, _ in rows], "merged": [b for _, b in rows]})

    kind = dict(tracks.dtypes)[group]
    return tracks.select(group, "track", "n", "mean", "frames").groupBy(group).applyInPandas(fold, f"`{group}` {kind}, track long, merged long")


def drop_outside(rows: DataFrame, track: str, x: str, y: str, half_x: float, half_y: float) -> DataFrame:
    """tracks go when fewer than half of their valid positions are inside; null tracks and those without positions stay."""
    valid = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    inside = valid & F.col(x).between(-half_x, half_x) & F.col(y).between(-half_y, half_y)
    counts = rows.where(F.col(track).isNotNull()).groupBy(track).agg(F.count_if(valid).alias("v"), F.count_if(inside).alias("i"))
    return rows.join(counts.where("v > 0 and i < v / 2").select(track), track, "left_anti")


def long_enough(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of tracks with at least so many rows."""
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("__n") >= least).drop("__n")


def uniform_sample(rows: DataFrame, track: str, order: list[str], most: int) -> DataFrame:
    """Of each track evenly spaced rows, the first and last included, half-even rounding of positions."""
    w = Window.partitionBy(track)
    k, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    placed = rows.withColumn("__k", k).withColumn("__n", n)
    # position k is chosen when some j in 0..most-1 rounds to it: j * (n - 1) / (most - 1)
    j = F.floor(F.col("__k") * (most - 1) / (F.col("__n") - 1))
    lands = lambda j: (j <= most - 1) & (F.bround(j * (F.col("__n") - 1) / (most - 1), 0) == F.col("__k"))
    chosen = (F.col("__n") <= most) | lands(j) | lands(j + 1)
    return placed.where(chosen).drop("__k", "__n")


def query_gallery(rows: DataFrame, person: str, row_key: str, ratio: float, seed: int = 0) -> DataFrame:
    """Per person ceil(n * ratio) rows, chosen by a seeded hash, are queries; the others gallery."""
    w = Window.partitionBy(person)
    rank = F.row_number().over(w.orderBy(F.xxhash64(F.col(row_key), F.lit(seed)), row_key))
    return rows.withColumn("split", F.when(rank <= F.ceil(F.count("*").over(w) * ratio), "query").otherwise("gallery"))


def dense_ids(rows: DataFrame, key: str, first_by: str | None = None) -> DataFrame:
    """W12 (by first appearance) and A54 (by value): keys with numbers from 0.

    The keys are summed up first; only distinct keys are numbered.
    """
    if first_by:
        keys = rows.groupBy(key).agg(F.min(first_by).alias("__f"))
        return ordered.numbered(keys, ["__f", key], "dense_id").select(key, "dense_id")
    return ordered.numbered(rows.select(key).distinct(), [key], "dense_id")


def sampled_videos(rows: DataFrame, video: str, n: int, seed: int = 2) -> DataFrame:
    """the rows of n videos, chosen by a seeded hash."""
    chosen = rows.select(video).distinct().orderBy(F.xxhash64(F.col(video), F.lit(seed)), video).limit(n)
    return rows.join(F.broadcast(chosen), video, "left_semi")


def number_range(rows: DataFrame, number: str, low: int, high: int) -> DataFrame:
    """numbers in the range, or 10000 above it; when none is, all rows stay."""
    n = F.col(number)
    inside = n.between(low, high) | (n + 10_000).between(low, high)
    found = rows.where(inside)
    return rows if found.isEmpty() else found


def reid_sample(rows: DataFrame, person: str, order: list[str], min_visibility: float, min_w: float, min_h: float, per_person: int, least: int, persons: int) -> DataFrame:
    """visible and large enough, evenly sampled per person, persons with enough rows, a seeded choice of persons."""
    ok = rows.where((F.col("visibility") >= min_visibility) & (F.col("w") > min_w) & (F.col("h") > min_h))
    return sampled_videos(long_enough(uniform_sample(ok, person, order, per_person), [person], least), person, persons)
