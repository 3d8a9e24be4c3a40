"""Media index curation: duplicates, consistency, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(rows: DataFrame, digest: Column, path: str, approved: Column | None = None) -> DataFrame:
    """Each row with the canonical path of its content: approved first, then the smallest path.

    Paths are summed up by content before the join, so a content with many copies is no window.
    """
    keyed = rows.withColumn("content", digest)
    rank = F.struct((~approved).alias("a") if approved is not None else F.lit(False).alias("a"), F.col(path))
    per = keyed.groupBy("content").agg(F.min_by(path, rank).alias("canonical"), F.count("*").alias("copies"))
    return keyed.join(per, "content").withColumn("duplicate", F.col(path) != F.col("canonical"))


def consolidated_labels(rows: DataFrame, label: str, role_rank: str, role: str, tactic: str) -> DataFrame:
    """Per label the role of highest rank and its only tactic; two tactics are an error."""
    named = F.when(F.trim(tactic) != "", F.col(tactic))
    per = rows.groupBy(label).agg(F.max_by(role, role_rank).alias(role), F.countDistinct(named).alias("__n"), F.max(named).alias(tactic))
    bad = F.raise_error(F.concat(F.lit("two tactics for "), F.col(label))).cast("string")
    return per.withColumn(tactic, F.when(F.col("__n") <= 1, F.col(tactic)).otherwise(bad)).drop("__n")


def inconsistent_groups(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Groups in which one of the columns has more than one value."""
    per = rows.groupBy(group).agg(*(F.countDistinct(c).alias(f"n_{c}") for c in columns))
    return per.where(" or ".join(f"n_{c} > 1" for c in columns))


def report(rows: DataFrame, sets: list[list[str]], measures: dict[str, Column]) -> DataFrame:
    """The measures for every set of keys in one pass; keys not in a set are null.

    ``level`` is the bit mask of the keys that were summed over.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    grouped = rows.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys))
    return grouped.agg(F.grouping_id().alias("level"), *(m.alias(n) for n, m in measures.items()))


def pattern_statistics(hits: DataFrame, video: str, pattern: str, score: str, t: str, hit: Column, periodic: Column) -> DataFrame:
    """Per video and pattern the best score, hits, periodic hits, first and last hit."""
    return hits.groupBy(video, pattern).agg(
        F.max(score).alias("best"), F.max_by(t, F.struct(F.col(score), -F.col(t))).alias("best_at"), F.count_if(hit).alias("hits"),
        F.count_if(hit & periodic).alias("periodic_hits"), F.min(F.when(hit, F.col(t))).alias("first"), F.max(F.when(hit, F.col(t))).alias("last"),
    )


def scene_samples(frames: DataFrame, video: str, frame: str, value: str, stride: int, delta: float) -> DataFrame:
    """Every ``stride``-th frame, and frames that differ by more than ``delta`` from the one before, unless
    another change came less than half a stride earlier."""
    w = Window.partitionBy(video).orderBy(frame)
    changed = F.coalesce(F.abs(F.col(value) - F.lag(value).over(w)) > delta, F.lit(False))
    marked = frames.withColumn("__c", changed).withColumn("__p", F.col(frame) % stride == 0)
    near = F.max(F.when(F.col("__c"), F.col(frame))).over(w.rangeBetween(-(stride // 2), -1)).isNotNull()
    kind = F.when(F.col("__p"), "periodic").when(F.col("__c") & ~near, "change")
    return marked.withColumn("sample", kind).where(F.col("sample").isNotNull()).drop("__c", "__p")


def migration_status(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Pending without a result, stale with another version, else existing."""
    o = old.select(F.col(key).alias("__k"), F.col(version).alias("__v"))
    status = F.when(F.col("__k").isNull(), "pending").when(~F.col("__v").eqNullSafe(F.col(version)), "stale").otherwise("existing")
    return new.join(o, F.col(key) == F.col("__k"), "left").select(*new.columns, status.alias("status"))


def approved_reviews(rows: DataFrame, decision: str, columns: list[str]) -> DataFrame:
    """Distinct approved rows; a decision that is neither approve nor reject nor empty is an error."""
    known = F.coalesce(F.lower(F.trim(decision)), F.lit("")).isin("approve", "reject", "")
    checked = F.when(known, F.lower(F.trim(decision)) == "approve").otherwise(F.raise_error(F.lit("unknown decision")).cast("boolean"))
    return rows.where(checked).select(*columns).distinct()


def only_row(rows: DataFrame) -> DataFrame:
    """The rows when there is exactly one, else an error."""
    n = len(rows.limit(2).collect())
    if n != 1:
        raise ValueError("exactly one row was expected")
    return rows


def chosen_text(results: Column, shortest: int = 30, longest: int = 120) -> Column:
    """The first text of trimmed length in range, else null."""
    return F.try_element_at(F.filter(results, lambda t: F.length(F.trim(t)).between(shortest, longest)), F.lit(1))
