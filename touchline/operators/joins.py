"""Interval, as-of, nearest and fallback joins.

Spark has no operator for range joins: a non-equi join runs as a nested loop. Here intervals are cut
into bins of a stated width, rows meet by an equi join on (key, bin), the exact condition follows,
and a pair is kept only in the first bin that both touch, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bin(value: Column, width: float) -> Column:
    return F.floor(value / width).cast("long")


def interval_join(
    a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: float, keys: list[str] | None = None, inclusive: bool = False
) -> DataFrame:
    """J14 (strict) and J15 (touching counts): pairs of overlapping intervals.

    Columns of the two sides must have different names but for ``keys``. ``width`` should be about
    the length of a usual interval: each row is copied once for each bin that it touches.
    """
    keys = keys or []
    binned = lambda df, span, name: df.withColumn(name, F.explode(F.sequence(_bin(F.col(span[0]), width), _bin(F.col(span[1]), width))))
    (s1, e1), (s2, e2) = ((F.col(x), F.col(y)) for x, y in (a_span, b_span))
    meets = (s1 <= e2) & (s2 <= e1) if inclusive else (s1 < e2) & (s2 < e1)
    right = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.col("__bin") == F.col("__other")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    joined = binned(a, a_span, "__bin").join(binned(right, b_span, "__other"), on)
    first = F.col("__bin") == F.greatest(_bin(s1, width), _bin(s2, width))
    return joined.where(meets & first).drop("__bin", "__other", *(f"__{k}" for k in keys))


def asof_latest(events: DataFrame, windows: DataFrame, at: str, span: tuple[str, str], width: float, keys: list[str] | None = None) -> DataFrame:
    """Each event with the window of latest start that contains it, both ends included; else nulls.
    Of equal starts the later end wins, then the larger row.

    events needs a unique column ``event_key``.
    """
    keys = keys or []
    points = events.withColumn("__s", F.col(at)).withColumn("__e", F.col(at))
    met = interval_join(points.select("event_key", "__s", "__e", *keys), windows, ("__s", "__e"), span, width, keys, inclusive=True)
    names = [c for c in windows.columns if c not in keys]
    latest = met.groupBy("event_key").agg(F.max_by(F.struct(*names), F.struct(*span, *names)).alias("__w"))
    return events.join(latest, "event_key", "left").select(*events.columns, *(F.col(f"__w.{c}").alias(c) for c in names))


def carried(events: DataFrame, key: str, order: list[str], value: str) -> Column:
    """The last value so far that is not null."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(value, ignorenulls=True).over(w)


def nearest(
    points: DataFrame, candidates: DataFrame, group: str, distance: Column, pos: str, limit: float, prefer: Column | None = None
) -> DataFrame:
    """For each row of points the nearest candidate of its group.

    Of equal distances the smallest ``pos`` wins; preferred candidates within the limit go first;
    beyond the limit there is none (the candidate's columns are null). ``distance`` is an expression
    over both sides' columns; points needs a unique column ``point_key``.
    """
    met = points.join(candidates.withColumnRenamed(group, "__g"), F.col(group) == F.col("__g")).withColumn("distance", distance)
    rank = F.struct((~(prefer & (F.col("distance") <= limit))).alias("r") if prefer is not None else F.lit(False).alias("r"), "distance", pos)
    names = [c for c in candidates.columns if c != group]
    best = met.groupBy("point_key").agg(F.min_by(F.struct("distance", *names), rank).alias("__b"))
    ok = F.col("__b.distance") <= limit
    return points.join(best, "point_key", "left").select(
        *points.columns, F.when(ok, F.col("__b.distance")).alias("distance"), *(F.when(ok, F.col(f"__b.{c}")).alias(c) for c in names)
    )


def fallback_lookup(candidates: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """The first row of the first source that has any for the key; ``choice`` tells which."""
    union = candidates[0].withColumn("choice", F.lit(0))
    for k, c in enumerate(candidates[1:], 1):
        union = union.unionByName(c.withColumn("choice", F.lit(k)))
    w = Window.partitionBy(key).orderBy("choice", *order)
    return union.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def within_frames(rows: DataFrame, events: DataFrame, frame: str, event_frame: str, band: int, keys: list[str] | None = None) -> DataFrame:
    """Rows and events at most ``band`` frames apart, by bins of that width."""
    a = rows.withColumn("__s", F.col(frame)).withColumn("__e", F.col(frame))
    b = events.withColumn("__b", F.col(event_frame) - band).withColumn("__f", F.col(event_frame) + band)
    return interval_join(a, b, ("__s", "__e"), ("__b", "__f"), 2 * band + 1, keys, inclusive=True).drop("__s", "__e", "__b", "__f")


def polyline_distance(points: DataFrame, lines: DataFrame, key: str, distance: Column) -> DataFrame:
    """For each point the least distance to the segments of its line; points has ``point_key``."""
    met = points.join(lines.withColumnRenamed(key, "__k"), F.col(key) == F.col("__k"))
    return met.groupBy("point_key").agg(F.min(distance).alias("distance"))
