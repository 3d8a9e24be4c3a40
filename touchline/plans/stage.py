"""Stages with declared columns, checked before anything runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from ..operators import frames as in_frames
from ..operators import merge

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """A function of tables with the columns that it needs and adds, by table."""

    name: str
    apply: Callable[[Tables], Tables]
    requires: dict[str, list[str]] = field(default_factory=dict)
    provides: dict[str, list[str]] = field(default_factory=dict)


def needed(stages: list[Stage]) -> dict[str, list[str]]:
    """The columns that must be loaded: required ones that no earlier stage provides."""
    made: dict[str, set[str]] = {}
    out: dict[str, list[str]] = {}
    for s in stages:
        for table, columns in s.requires.items():
            for c in columns:
                if c not in made.get(table, set()) and c not in out.get(table, []):
                    out.setdefault(table, []).append(c)
        for table, columns in s.provides.items():
            made.setdefault(table, set()).update(columns)
    return out


def validate(stages: list[Stage], loaded: dict[str, list[str]]) -> None:
    """Every stage's columns are loaded or provided before it."""
    known = {t: set(c) for t, c in loaded.items()}
    for s in stages:
        for table, columns in s.requires.items():
            missing = set(columns) - known.get(table, set())
            if missing:
                raise ValueError(f"{s.name} needs {sorted(missing)} of {table}")
        for table, columns in s.provides.items():
            known.setdefault(table, set()).update(columns)


def run_stages(stages: list[Stage], tables: Tables) -> Tables:
    """Validated, then applied in order; a stage that does not give what it declared is an error."""
    validate(stages, {t: df.columns for t, df in tables.items()})
    for s in stages:
        tables = {**tables, **s.apply(tables)}
        for table, columns in s.provides.items():
            missing = set(columns) - set(tables[table].columns)
            if missing:
                raise ValueError(f"{s.name} did not provide {sorted(missing)} of {table}")
    return tables


# Stages of three levels, each made from a plain function


def _schema(table: DataFrame, keys: list[str], provides: dict[str, str]) -> str:
    kinds = dict(table.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{c}` {t}" for c, t in provides.items())])


def step(table: DataFrame, key: str, provides: dict[str, str], module: Callable[[DataFrame], DataFrame], where: Column | None = None) -> DataFrame:
    """The module sees the chosen rows only; what it gives is merged by key, other rows keep what they have, or null."""
    made = module(table if where is None else table.where(where)).select(key, *provides)
    return merge.upsert_merge(table, made, key)


def detections_stage(name: str, fn: Callable[[pd.DataFrame], pd.DataFrame], requires: list[str], provides: dict[str, str], key: str = "det_id", where: Column | None = None) -> Stage:
    """A function of a batch of rows, in whichever batches they come; it gets ``key`` and ``requires`` and gives ``key`` and ``provides``."""

    def module(rows: DataFrame) -> DataFrame:
        chosen = rows.select(key, *requires)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield fn(batch)[[key, *provides]]

        return chosen.mapInPandas(run, _schema(chosen, [key], provides))

    return Stage(name, lambda t: {"detections": step(t["detections"], key, provides, module, where)}, {"detections": [key, *requires]}, {"detections": list(provides)})


def _grouped(name: str, by: str, fn: Callable[[pd.DataFrame], pd.DataFrame], requires: list[str], provides: dict[str, str], key: str, where: Column | None, many: bool) -> Stage:
    def run(rows: pd.DataFrame, firsts: np.ndarray) -> pd.DataFrame:
        parts = [rows] if many else [rows.iloc[a:b] for a, b in zip(firsts, [*firsts[1:], len(rows)], strict=True)]
        return pd.concat([fn(part)[[key, *provides]] for part in parts])

    def module(rows: DataFrame) -> DataFrame:
        chosen = rows.select(*dict.fromkeys([key, by, *requires]))
        return in_frames.by_group(chosen, [by], run, _schema(chosen, [key], provides))

    return Stage(name, lambda t: {"detections": step(t["detections"], key, provides, module, where)}, {"detections": list(dict.fromkeys([key, by, *requires]))}, {"detections": list(provides)})


def images_stage(name: str, fn: Callable[[pd.DataFrame], pd.DataFrame], requires: list[str], provides: dict[str, str], key: str = "det_id", where: Column | None = None, many: bool = False) -> Stage:
    """A function of the rows of one image; with ``many`` of those of many whole images, which it tells apart by image_id, so that small images cost no call each."""
    return _grouped(name, "image_id", fn, requires, provides, key, where, many)


def videos_stage(name: str, fn: Callable[[DataFrame], DataFrame], requires: list[str], provides: dict[str, str], key: str = "det_id", where: Column | None = None) -> Stage:
    """A function of the tables of all videos, which groups by video_id itself, so that a long video need not be one task."""
    return Stage(name, lambda t: {"detections": step(t["detections"], key, provides, fn, where)}, {"detections": list(dict.fromkeys([key, "video_id", *requires]))}, {"detections": list(provides)})


@dataclass(frozen=True)
class Evaluator:
    """A function of the finished tables that gives result rows; it adds nothing to them."""

    name: str
    run: Callable[[Tables], DataFrame]
    requires: dict[str, list[str]] = field(default_factory=dict)


def evaluated(evaluators: Iterable[Evaluator], tables: Tables) -> dict[str, DataFrame]:
    """Every evaluator's rows; a column that one needs and that is missing is an error before any runs."""
    evaluators = list(evaluators)
    for e in evaluators:
        for table, columns in e.requires.items():
            missing = set(columns) - set(tables[table].columns if table in tables else ())
            if missing:
                raise ValueError(f"{e.name} needs {sorted(missing)} of {table}")
    return {e.name: e.run(tables) for e in evaluators}


def forgotten(tables: Tables, columns: dict[str, list[str]]) -> Tables:
    """Tables without the columns that are not kept; columns that are not there are ignored."""
    return {t: df.drop(*columns.get(t, [])) for t, df in tables.items()}
