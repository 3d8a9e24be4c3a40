"""Running sums and numbers over a total order of a whole table.

A window without partitions sends all rows to one task. Here the order is cut into ranges at
quantiles of its leading column, running sums are made within each range, and the sums of the ranges
before it are added: their table has one row for each range, whatever the number of rows. A value
that fills a range by itself, as one score of a third of all rows would, is cut again by ``spread``.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most ranges that an order is cut into; the session's shuffle partitions may ask for fewer.
RANGES = 256


def _number(name: str, kind: str) -> tuple[Column, bool]:
    """A number that never falls along the order of the column, and whether it differs wherever the column does."""
    if kind in ("string", "binary"):
        lead = F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 6)), 12, "0")
        return F.conv(lead, 16, 10).cast("long"), False
    if kind in ("date", "timestamp", "timestamp_ntz", "boolean"):
        return (F.col(name).cast("int") if kind == "boolean" else F.unix_micros(F.col(name).cast("timestamp"))), True
    return F.col(name), True


def _cut(value: Column, bounds: list) -> Column:
    """2 * (bounds below the value), one more where it equals the next one, -1 for null; found by halving, whole batches at once."""
    if not bounds:
        return F.when(value.isNull(), -1).otherwise(0)
    every = np.array(bounds) if not isinstance(bounds[0], Decimal) else np.array(bounds, object)

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        v = v.to_numpy()
        n = np.searchsorted(every, v)
        at = every[np.minimum(n, len(every) - 1)]
        same = (at == v) | ((at != at) & (v != v))
        return pd.Series((2 * n + ((n < len(every)) & same)).astype(np.int32))

    return F.when(value.isNull(), -1).otherwise(place(F.coalesce(value, F.lit(bounds[0]))))


def _bounds(rows: DataFrame, values: dict[str, Column], ranges: int) -> dict[str, list]:
    """Quantiles of several columns from one pass: at most ``ranges`` - 1 numbers each come to the driver."""
    shares = [k / ranges for k in range(1, ranges)]
    found = rows.agg(*(F.percentile_approx(v, shares, 20 * ranges).alias(n) for n, v in values.items())).first()
    return {n: sorted(set(found[n] or [])) for n in values}


def ranged(rows: DataFrame, lead: str, name: str, ranges: int = RANGES, falling: bool = False, spread: str | None = None) -> DataFrame:
    """rows with the number of the range that a column's value is in; larger values are never in a lower range, or with ``falling`` in a higher one.

    Rows of a value that fills a range by itself are cut again by ``spread``, a number that never falls where the value is the same.
    """
    value, strict = _number(lead, dict(rows.dtypes)[lead])
    asked = {"lead": value} | ({"spread": F.col(spread)} if spread and strict else {})
    bounds = _bounds(rows, asked, ranges)
    cell = _cut(value, bounds["lead"])
    placed = rows.withColumn(name, -cell if falling else cell)
    if "spread" not in asked:
        return placed
    part = F.when(F.col(name) % 2 != 0, _cut(F.col(spread), bounds["spread"])).otherwise(0)
    return placed.withColumn(name, F.col(name).cast("long") * (2 * ranges + 2) + part)


def running(
    rows: DataFrame, lead: str, rest: list[str], sums: dict[str, Column], falling: bool = False, group: str | None = None, spread: str | None = None, ranges: int | None = None
) -> DataFrame:
    """rows with running sums and, as ``<name>_all``, whole sums of each group.

    The order is ``lead``, falling with nulls last or rising with nulls first, then ``rest``, rising. ``spread`` is the
    column, numeric, that ``rest`` begins with or is ordered by; equal values of ``lead`` are cut by it. Rows equal in all
    of these may change places.
    """
    spark, kinds = rows.sparkSession, dict(rows.dtypes)
    ranges = ranges or max(2, min(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    value, strict = _number(lead, kinds[lead])
    asked = {"lead": value} | ({"spread": F.col(spread)} if spread and strict else {})
    bounds = _bounds(rows, asked, ranges)
    cell = _cut(value, bounds["lead"])
    part = F.when(F.col("__cell") % 2 != 0, _cut(F.col(spread), bounds["spread"])).otherwise(0) if "spread" in asked else F.lit(0)
    placed = rows.withColumn("__cell", -cell if falling else cell).select(
        "*", part.alias("__part"), *(F.coalesce(v.cast("long"), F.lit(0).cast("long")).alias(f"__v_{n}") for n, v in sums.items())
    )
    keys = [*([group] if group else []), "__cell", "__part"]
    order = [F.desc(lead) if falling else F.asc(lead), *(F.asc(c) for c in rest)]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*([F.col("__g")] if group else []))  # over one row for each range
    before = whole.orderBy("__at", "__in").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys).agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums))
    totals = totals.select(*([F.col(group).alias("__g")] if group else []), F.col("__cell").alias("__at"), F.col("__part").alias("__in"), *(f"__t_{n}" for n in sums))
    shifts = totals.select(
        *(c for c in totals.columns if not c.startswith("__t_")),
        *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums), *(F.sum(f"__t_{n}").over(whole).alias(f"{n}_all") for n in sums),
    )
    summed = placed.select("*", *(F.sum(f"__v_{n}").over(within).alias(f"__w_{n}") for n in sums))
    same = (F.col("__cell") == F.col("__at")) & (F.col("__part") == F.col("__in"))
    met = summed.join(shifts, same & F.col(group).eqNullSafe(F.col("__g")) if group else same)
    return met.select(*(F.col(f"`{c}`") for c in rows.columns), *((F.col(f"__w_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums), *(f"{n}_all" for n in sums))


def numbered(keys: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Different rows with their number in the order of some columns."""
    out = running(keys, order[0], order[1:], {"__no": F.lit(1)})
    return out.withColumn(name, F.col("__no") - 1 + start).drop("__no", "__no_all")
