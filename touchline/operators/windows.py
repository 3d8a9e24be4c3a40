"""Ordered operators: islands, sessions, trailing frames, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flag_islands(rows: DataFrame, group: str, order: list[str], flag: Column, measure: str, start: str) -> DataFrame:
    """Maximal runs of flagged rows in row order; gaps in numbering do not break a run."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = rows.withColumn("__f", flag).withColumn("__b", F.coalesce((F.lag("__f").over(w) != F.col("__f")).cast("int"), F.lit(0)))
    runs = marked.withColumn("__i", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__f")
    return runs.groupBy(group, "__i").agg(
        F.min(start).alias("first"), F.max(start).alias("last"), F.count("*").alias("n"), F.avg(measure).alias("mean")
    ).drop("__i")


def calibration_dropouts(frames: DataFrame, group: str, frame: str, valid: Column, keypoints: str, least: int = 5, most: float = 2.0, share: float = 0.25) -> DataFrame:
    """Runs of at least ``least`` invalid frames with few keypoints, absolutely and against the valid frames' mean."""
    base = frames.groupBy(group).agg(F.coalesce(F.avg(F.when(valid, F.col(keypoints))), F.avg(keypoints)).alias("baseline"))
    runs = flag_islands(frames, group, [frame], ~valid, keypoints, frame).join(base, group)
    return runs.where((F.col("n") >= least) & (F.col("mean") <= most) & (F.col("mean") <= share * F.col("baseline")))


def frame_sessions(rows: DataFrame, keys: list[str], frame: str, short: int) -> DataFrame:
    """Segments of consecutive frames with their length and whether they are short; frames are unique per key."""
    w = Window.partitionBy(*keys).orderBy(frame)
    island = F.col(frame) - F.row_number().over(w)
    runs = rows.withColumn("__i", island).groupBy(*keys, "__i").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count("*").alias("n"))
    return runs.withColumn("short", F.col("n") < short).drop("__i")


def trailing_outliers(rows: DataFrame, track: str, frame: str, value: str, back: int = 2, ratio: float = 1.4) -> DataFrame:
    """Value over the mean of the ``back`` frames before it, when all of them are there; else null and no outlier."""
    w = Window.partitionBy(track).orderBy(frame).rangeBetween(-back, -1)
    full = F.count("*").over(w) == back
    mean = F.when(full, F.avg(value).over(w))
    flag = F.coalesce(F.col(value) > ratio * mean, F.lit(False))
    return rows.withColumn("trailing_mean", mean).withColumn("outlier", flag)


def trailing_majority(rows: DataFrame, track: str, frame: str, value: str, back: int = 50, least: int = 5, share: float = 2 / 3) -> DataFrame:
    """The value with more than ``share`` of more than ``least`` matches in the last ``back`` frames, else null."""
    w = Window.partitionBy(track).orderBy(frame).rangeBetween(-back, -1)
    seen = rows.withColumn("__h", F.collect_list(value).over(w))
    counts = F.transform(F.array_distinct("__h"), lambda v: F.struct(F.size(F.filter("__h", lambda x: x == v)).alias("n"), v.alias("v")))
    best = F.array_max(counts)
    ok = (F.size("__h") > least) & (best["n"] > share * F.size("__h"))
    return seen.withColumn("majority", F.when(ok, best["v"])).drop("__h")


def fragments(rows: DataFrame, obj: str, order: list[str], tracked: Column) -> DataFrame:
    """Per object the changes from tracked to missed between its first and last tracked row."""
    w = Window.partitionBy(obj).orderBy(*order)
    flagged = rows.withColumn("__t", tracked.cast("int"))
    after = F.coalesce(F.max("__t").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    lost = (F.lag("__t").over(w) == 1) & (F.col("__t") == 0) & (after == 1)
    return flagged.withColumn("__l", F.coalesce(lost, F.lit(False)).cast("int")).groupBy(obj).agg(F.sum("__l").alias("n_fragments"))


def path_length(rows: DataFrame, obj: str, order: list[str], x: str, y: str) -> DataFrame:
    """The sum of step distances."""
    w = Window.partitionBy(obj).orderBy(*order)
    step = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))
    return rows.withColumn("__d", step).groupBy(obj).agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("length"))


def until_jump(rows: DataFrame, track: str, frame: str, x: str, y: str, prompt: str, most: float) -> DataFrame:
    """The rows reached from the prompt frame without a missing frame or a centre jump above ``most``."""
    w = Window.partitionBy(track).orderBy(frame)
    breaks = (F.col(frame) - F.lag(frame).over(w) > 1) | (F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) > most)
    runs = rows.withColumn("__b", F.coalesce(breaks.cast("int"), F.lit(0)))
    runs = runs.withColumn("__r", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = runs.where(F.col(frame) == F.col(prompt)).select(F.col(track).alias("__t"), F.col("__r").alias("__own"))
    return runs.join(own, (F.col(track) == F.col("__t")) & (F.col("__r") == F.col("__own"))).drop("__b", "__r", "__t", "__own")


def gap_split(rows: DataFrame, group: str, value: str, tie: list[str], gap: float, spread: float, most: int = 2) -> DataFrame:
    """Members in order of value, split at up to ``most`` largest gaps of at least ``gap``.

    Without such a gap, a group whose spread reaches ``spread`` is split at its largest gap. Adds part
    (from 0) and n_parts; groups of fewer than two members get part null.
    """
    w = Window.partitionBy(group)
    by = w.orderBy(value, *tie)
    # one sort serves all windows below: numbers and gaps come first, whatever looks at a whole group reads the same order
    step = rows.withColumn("__k", F.row_number().over(by)).withColumn("__g", F.col(value) - F.lag(value).over(by))
    late, early = F.struct("__g", "__k"), F.struct(F.col("__g").alias("g"), (-F.col("__k")).alias("k"))
    ranked = step.withColumns({
        "__n": F.count("*").over(w), "__wide": F.max(value).over(w) - F.min(value).over(w) >= spread, "__any": F.coalesce(F.max("__g").over(w) >= gap, F.lit(False)),
        "__early": F.max(early).over(w)["k"] == -F.col("__k"), "__last": F.max(late).over(w),
    })
    for _ in range(most - 1):  # the next largest gap, the later one of equals
        ranked = ranked.withColumn("__last", F.coalesce(F.max(F.when(late < F.col("__last"), late)).over(w), F.col("__last")))
    cut = F.when(F.col("__any"), (F.col("__g") >= gap) & (late >= F.col("__last")) & F.lit(most > 0)).otherwise(F.col("__wide") & F.col("__early") & F.col("__g").isNotNull())
    parts = ranked.withColumn("__c", F.coalesce(cut, F.lit(False)).cast("int"))
    parts = parts.withColumn("part", F.when(F.col("__n") >= 2, F.sum("__c").over(by.rowsBetween(Window.unboundedPreceding, 0))))
    parts = parts.withColumn("n_parts", F.max("part").over(w) + 1)
    return parts.drop("__n", "__k", "__g", "__any", "__wide", "__last", "__early", "__c")


def identity_switches(matches: DataFrame, sequence: str, gt: str, frame: str, tracker: str) -> DataFrame:
    """Matched rows whose tracker id differs from the object's last matched one."""
    w = Window.partitionBy(sequence, gt).orderBy(frame).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(tracker, ignorenulls=True).over(w)
    return matches.withColumn("switch", F.coalesce(F.col(tracker) != before, F.lit(False)))


def sliding_windows(rows: DataFrame, t: str, length: int, stride: int) -> DataFrame:
    """Each row in every half-open window [k * stride, k * stride + length) that holds it; adds ``window``.

    Times and both lengths are whole units, so that window starts are exact; ``window`` is k >= 0.
    """
    last = F.floor(F.col(t) / stride)
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(t) - length) / stride) + 1)
    return rows.withColumn("window", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
