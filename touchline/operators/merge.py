"""Merging and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def upsert_merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer alignment on the key; a value of the right wins unless it is null."""
    r = right.select(*(F.col(c).alias(f"__r_{c}") for c in right.columns))
    joined = left.join(r, F.col(key) == F.col(f"__r_{key}"), "full_outer")
    shared = [c for c in left.columns if c in right.columns]
    out = [F.coalesce(F.col(f"__r_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in left.columns]
    out += [F.col(f"__r_{c}").alias(c) for c in right.columns if c not in left.columns]
    return joined.select(*out)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the new keys replace the old ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has no result yet."""
    return work.join(done.select(*keys), keys, "left_anti")


def kept(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is among the kept ids."""
    return rows.join(ids.select(*keys), keys, "left_semi")


def one_to_one(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Inner join that is an error where a key repeats on either side."""
    def unique(df: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(key))
        bad = F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string")))
        return df.withColumn("__n", n).where(F.when(F.col("__n") > 1, bad.cast("boolean")).otherwise(True)).drop("__n")

    return unique(left).join(unique(right.select(key, *columns)), key)


def checked_manifest(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows of the manifest's ids; ids of the manifest without a row are an error."""
    missing = manifest.select(key).distinct().join(rows.select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"missing: {[r[0] for r in missing]}")
    return kept(rows, manifest, [key])


def compose_matches(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b) and (b, c) to (a, c); and the ends on either side that found no partner."""
    matches = first.join(second, "b").select("a", "c")
    return matches, first.join(second, "b", "left_anti").select("a"), second.join(first, "b", "left_anti").select("c")


def union_first(sources: list[DataFrame], key: str) -> DataFrame:
    """Union in which an earlier source's row hides later ones of the same key."""
    tagged = [s.withColumn("__source", F.lit(k)) for k, s in enumerate(sources)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    order = Window.partitionBy(key).orderBy("__source")
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__source")


def subtract(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other side does not have."""
    return rows.join(other.select(key), key, "left_anti")


def mutual_duplicates(a: DataFrame, b: DataFrame, pairs: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """Of pairs (a_id, b_id, distance) closer than ``limit`` the younger track goes; tracks are (id, age)."""
    close = (
        pairs.where(F.col("distance") < limit)
        .join(a.select(F.col("id").alias("a_id"), F.col("age").alias("a_age")), "a_id")
        .join(b.select(F.col("id").alias("b_id"), F.col("age").alias("b_age")), "b_id")
    )
    gone_a = close.where("a_age <= b_age").select(F.col("a_id").alias("id"))
    gone_b = close.where("a_age > b_age").select(F.col("b_id").alias("id"))
    return a.join(gone_a, "id", "left_anti"), b.join(gone_b, "id", "left_anti")


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every id with where it stands: left, right or both."""
    a = left.select(key).distinct().withColumn("__l", F.lit(True))
    b = right.select(key).distinct().withColumn("__r", F.lit(True))
    side = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left").otherwise("right")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def registry_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """An entry is replaced by name or appended."""
    return upsert_merge(old, new, key)


def combined_classes(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per key the rows of all classes in one list, in order of class and position."""
    entry = F.struct("class", "pos", *values)
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("items"))


def rebased_events(events: DataFrame, sequence: str, frame: str, ids: list[str]) -> DataFrame:
    """Frames continue over sequences; ids become dense numbers of (sequence, id)."""
    frames = events.groupBy(sequence).agg((F.max(frame) + 1).alias("__n"))
    shift = ordered.running(frames, sequence, [], {"__upto": F.col("__n")}).select(sequence, (F.col("__upto") - F.col("__n")).alias("__shift"))
    out = events.join(shift, sequence).withColumn(frame, F.col(frame) + F.col("__shift")).drop("__shift")
    for c in ids:
        known = events.where(F.col(c).isNotNull()).select(sequence, c).distinct()
        dense = ordered.numbered(known, [sequence, c], "__new")
        out = out.join(dense, [sequence, c], "left").withColumn(c, F.col("__new")).drop("__new")
    return out
