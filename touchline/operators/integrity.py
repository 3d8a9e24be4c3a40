"""Data quality: rules as columns, rejects, reports (F06, F10-F15, A44 detection, A49)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_findings(rows: DataFrame, rules: dict[str, Column], name: str = "findings") -> DataFrame:
    """the codes of all rules that a row breaks; a rule is broken where its column is true."""
    return rows.withColumn(name, F.array_compact(F.array(*(F.when(rule, F.lit(code)) for code, rule in rules.items()))))


def split_rejects(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """rows that break nothing, and the others with their codes."""
    checked = with_findings(rows, rules)
    return checked.where(F.size("findings") == 0).drop("findings"), checked.where(F.size("findings") > 0)


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_references(rows: DataFrame, column: str, others: DataFrame, key: str) -> DataFrame:
    """rows whose reference has no target."""
    return rows.where(F.col(column).isNotNull()).join(others.select(F.col(key).alias("__k")), F.col(column) == F.col("__k"), "left_anti")


def severity_report(rows: DataFrame, split: str, errors: Column, warnings: Column) -> DataFrame:
    """Per split rows, rows without errors, errors and warnings."""
    return rows.groupBy(split).agg(
        F.count("*").alias("rows"), F.count_if(errors == 0).alias("ok"), F.sum(errors).alias("errors"), F.sum(warnings).alias("warnings")
    )


def uncited(analysis: DataFrame, cited: str, available: str) -> DataFrame:
    """rows that cite an id which is not available."""
    return analysis.where(F.size(F.array_except(cited, available)) > 0)


def legal_annotation(ids: Column, others: list[Column], most: int = 300) -> Column:
    """not empty, ids unique, at most ``most``; unequal lengths are an error."""
    same = F.lit(True)
    for o in others:
        same = same & (F.size(o) == F.size(ids))
    ok = (F.size(F.array_distinct(ids)) == F.size(ids)) & F.size(ids).between(1, most)
    return F.when(same, ok).otherwise(F.raise_error(F.lit("arrays of one annotation differ in length")).cast("boolean"))


def span_rules(start: Column, end: Column, duration: Column) -> dict[str, Column]:
    """what can be wrong with an evidence span."""
    return {"span_missing": start.isNull() | end.isNull(), "span_order": start >= end, "span_outside": (start < 0) | (end > duration)}


def repaired_track_ids(rows: DataFrame, frame: str, track: str, order: list[str], step: int = 100_000) -> DataFrame:
    """Of rows with one (frame, track) the first keeps its id, the k-th one more gets id + k * step."""
    w = Window.partitionBy(frame, track).orderBy(*order)
    return rows.withColumn(track, F.col(track) + (F.row_number().over(w) - 1) * step)
