"""Metrics that name what they need: one shared aggregation, then columns in dependency order.

A metric is a function of the names of its arguments. A *counter* gets columns of the events and gives
an aggregate; counters of objects get the counters of each object first. A *measure* gets other
metrics, whatever their kind. Asked metrics are resolved to the counters that they need, these are
computed in one aggregation over one scan of the events, and each measure becomes one column. Counters
are mergeable: a table of them per sequence is kept and merged into any larger group, so overall
results cost no second scan.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    name: str
    kind: str  # 'counter', 'object' or 'measure'
    make: Callable[..., Column]
    needs: tuple[str, ...]
    merge: Callable[[Any], Column] = F.sum
    help: str = ""


class Registry:
    """Metrics by name; ``oid`` is the events' column that tells objects apart."""

    def __init__(self, oid: str = "oid"):
        self.oid = oid
        self.metrics: dict[str, Metric] = {}

    def _add(self, kind: str, make: Callable[..., Column], name: str | None, needs: Iterable[str] | None, merge: Callable[[Any], Column]) -> Callable[..., Column]:
        name = name or make.__name__
        if name in self.metrics:
            raise ValueError(f"metric {name} is registered already")
        self.metrics[name] = Metric(name, kind, make, tuple(needs if needs is not None else inspect.signature(make).parameters), merge, inspect.getdoc(make) or "")
        return make

    def counter(self, make: Callable[..., Column] | None = None, *, name: str | None = None, needs: Iterable[str] | None = None, merge: Callable[[Any], Column] = F.sum):
        """Register an aggregate of the events' columns that its arguments name; ``merge`` joins counts of parts."""
        if make is None:
            return lambda f: self._add("counter", f, name, needs, merge) and f
        return self._add("counter", make, name, needs, merge)

    def per_object(self, make: Callable[..., Column] | None = None, *, name: str | None = None, needs: Iterable[str] | None = None, merge: Callable[[Any], Column] = F.sum):
        """Register an aggregate over objects; its arguments name counters, made for each object of a group."""
        if make is None:
            return lambda f: self._add("object", f, name, needs, merge) and f
        return self._add("object", make, name, needs, merge)

    def measure(self, make: Callable[..., Column] | None = None, *, name: str | None = None, needs: Iterable[str] | None = None):
        """Register a column made from the metrics that its arguments name."""
        if make is None:
            return lambda f: self._add("measure", f, name, needs, F.sum) and f
        return self._add("measure", make, name, needs, F.sum)

    def order(self, asked: Iterable[str]) -> list[Metric]:
        """The asked metrics and all that they need, each after what it needs; a missing name or a circle is an error."""
        done: dict[str, Metric] = {}
        open_: list[str] = []

        def visit(name: str, by: str) -> None:
            if name in done:
                return
            if name not in self.metrics:
                raise KeyError(f"{by} needs the metric {name}, which is not registered")
            if name in open_:
                raise ValueError("metrics need each other: " + " -> ".join([*open_[open_.index(name) :], name]))
            open_.append(name)
            one = self.metrics[name]
            if one.kind == "object" and [n for n in one.needs if n in self.metrics and self.metrics[n].kind != "counter"]:
                raise ValueError(f"{name} is made over objects and can only need counters")
            for need in one.needs if one.kind != "counter" else ():
                visit(need, name)
            open_.pop()
            done[name] = one

        for name in asked:
            visit(name, "the caller")
        return list(done.values())

    def partials(self, events: DataFrame, asked: Iterable[str], keys: list[str] | None = None) -> DataFrame:
        """keys and every counter that the asked metrics need, by one scan: by object first if any metric is made over objects."""
        keys, chosen = keys or [], self.order(asked)
        counters, objects = [m for m in chosen if m.kind == "counter"], [m for m in chosen if m.kind == "object"]
        made = [m.make(*(F.col(c) for c in m.needs)).alias(m.name) for m in counters]
        if not objects:
            return events.groupBy(*keys).agg(*made) if made else events.select(*keys).distinct()
        by_object = events.groupBy(*keys, self.oid).agg(*made)
        own = [m.make(*(F.when(F.col(self.oid).isNotNull(), F.col(c)) for c in m.needs)).alias(m.name) for m in objects]
        return by_object.groupBy(*keys).agg(*(m.merge(m.name).alias(m.name) for m in counters), *own)

    def merged(self, partials: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """Counters of larger groups from those of their parts."""
        keys = keys or []
        return partials.groupBy(*keys).agg(*(self.metrics[c].merge(c).alias(c) for c in partials.columns if c in self.metrics and c not in keys))

    def finished(self, partials: DataFrame, asked: Iterable[str], keys: list[str] | None = None) -> DataFrame:
        """keys and the asked metrics; a measure that several need is one column, made once."""
        asked = list(asked)
        out = partials
        for m in self.order(asked):
            if m.kind == "measure":
                out = out.withColumn(m.name, m.make(*(F.col(c) for c in m.needs)))
        return out.select(*(keys or []), *asked)

    def compute(self, events: DataFrame, asked: Iterable[str], keys: list[str] | None = None) -> DataFrame:
        """The asked metrics of each group of the keys, of all events without keys."""
        asked = list(asked)
        return self.finished(self.partials(events, asked, keys), asked, keys)

    def compute_overall(self, partials: DataFrame, asked: Iterable[str], keys: list[str] | None = None) -> DataFrame:
        """The asked metrics of merged partials."""
        return self.finished(self.merged(partials, keys), asked, keys)

    def compute_many(self, events: DataFrame, asked: Iterable[str], key: str, overall: str | None = "OVERALL") -> DataFrame:
        """The asked metrics of each value of ``key`` and, as ``overall``, of all; the events are scanned once."""
        asked = list(asked)
        parts = self.partials(events, asked, [key]).withColumn(key, F.col(key).cast("string"))
        if overall is None:
            return self.finished(parts, asked, [key])
        # each part counts twice: under its own name and under the common one
        both = parts.withColumn(key, F.explode(F.array(F.col(key), F.lit(overall))))
        return self.compute_overall(both, asked, [key])


def tracking_registry() -> Registry:
    """The usual metrics over event tables (type, oid, hid, distance)."""
    r = Registry()
    several = lambda *kinds: lambda type: F.count_if(type.isin(*kinds))
    for name, kinds in {
        "num_matches": ("MATCH",), "num_switches": ("SWITCH",), "num_misses": ("MISS",), "num_false_positives": ("FP",), "num_detections": ("MATCH", "SWITCH"),
        "num_objects": ("MATCH", "SWITCH", "MISS"), "num_predictions": ("MATCH", "SWITCH", "FP"),
    }.items():
        r.counter(several(*kinds), name=name)
    r.counter(lambda distance: F.coalesce(F.sum(distance), F.lit(0.0)), name="sum_distance")
    ratio = lambda found, all_: F.try_divide(found.cast("double"), all_)
    r.per_object(lambda num_objects: F.count(num_objects), name="num_unique_objects")
    r.per_object(lambda num_detections, num_objects: F.count_if(ratio(num_detections, num_objects) >= 0.8), name="mostly_tracked")
    r.per_object(lambda num_detections, num_objects: F.count_if((ratio(num_detections, num_objects) >= 0.2) & (ratio(num_detections, num_objects) < 0.8)), name="partially_tracked")
    r.per_object(lambda num_detections, num_objects: F.count_if(ratio(num_detections, num_objects) < 0.2), name="mostly_lost")
    r.measure(lambda num_misses, num_switches, num_false_positives, num_objects: 1 - ratio(num_misses + num_switches + num_false_positives, num_objects), name="mota")
    r.measure(lambda sum_distance, num_detections: ratio(sum_distance, num_detections), name="motp")
    r.measure(lambda num_detections, num_false_positives: ratio(num_detections, num_detections + num_false_positives), name="precision")
    r.measure(lambda num_detections, num_objects: ratio(num_detections, num_objects), name="recall")
    r.measure(lambda precision, recall: ratio(2 * precision * recall, precision + recall), name="f1")
    return r
