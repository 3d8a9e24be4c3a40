"""Folds over the frames of a sequence in order, without a whole sequence in memory.

Rows go to the task of their sequence and are sorted there by frame, which spills; they arrive in
Arrow batches. A frame that a batch cuts is held until its rest has come, so a task holds a batch,
one frame and the state of one sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def whole_frames(batches: Iterator[pd.DataFrame], group: str, frame: str) -> Iterator[tuple[bool, pd.DataFrame]]:
    """(new, rows): rows of whole frames of one sequence, in order; new tells that the sequence begins with them."""
    held, before, begun = None, None, False
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if rows.empty:
            continue
        cut = len(rows)
        last = (rows[group] == rows[group].iloc[-1]) | (rows[group].isna() & pd.isna(rows[group].iloc[-1]))
        open_ = (last & (rows[frame] == rows[frame].iloc[-1])).to_numpy()
        cut = int(open_.argmax())
        held = rows.iloc[cut:].reset_index(drop=True)
        for name, part in rows.iloc[:cut].groupby(group, sort=False, dropna=False):
            new = not begun or not _same(name, before)
            before, begun = name, True
            yield new, part.reset_index(drop=True)
    if held is not None and len(held):
        yield not begun or not _same(held[group].iloc[0], before), held


def _same(a: Any, b: Any) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, firsts): rows of many whole groups, and where each of them begins; the group that a batch cuts is held until its rest has come."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        new = np.zeros(len(batch), bool)
        for k in keys:
            before = batch[k].shift()
            new |= ~((batch[k] == before) | (batch[k].isna() & before.isna())).to_numpy(bool)
        new[0] = bool(held) and not all(_same(held[-1][k].iloc[-1], batch[k].iloc[0]) for k in keys)
        starts = np.flatnonzero(new)
        if not len(starts):
            held.append(batch)
            continue
        rows = pd.concat([*held, batch.iloc[: starts[-1]]], ignore_index=True)
        own = sum(map(len, held))
        yield rows, np.concatenate([[0], starts[:-1] + own])
        held = [batch.iloc[starts[-1] :]]
    if held:
        yield pd.concat(held, ignore_index=True), np.zeros(1, np.int64)


#: Rows that a call of numbers gets at least: below that its fixed costs count more than its rows.
CALL = 100_000


def _gathered(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """The same rows in fewer batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= least:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def by_group(
    rows: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, together: list[str] | None = None,
    then: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame] | None = None,
) -> DataFrame:
    """``fn`` of the rows of many whole groups at once and of where each begins; for groups so small that a call for each costs more than its work.

    Groups equal in ``together``, the first of the keys, follow each other in one task; ``then`` takes, there and without a shuffle,
    what ``fn`` gave for them, its rows in the order of their groups; rows are numbers then, and many batches make a call.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = (fn(some, firsts) for some, firsts in whole_groups(_gathered(batches, CALL) if then else batches, keys))
        if then:
            done = (then(some, firsts) for some, firsts in whole_groups(done, together))
        yield from done

    return rows.repartition(*(together or keys)).sortWithinPartitions(*keys).mapInPandas(run, schema)


def fold(
    rows: DataFrame, group: str, frame: str, start: Callable[[], Any], step: Callable[[Any, pd.DataFrame], pd.DataFrame | None], schema: str,
    finish: Callable[[Any], pd.DataFrame] | None = None,
) -> DataFrame:
    """``step`` takes a sequence's state and rows of some whole frames and gives rows; ``finish`` gives the rows at its end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for new, part in whole_frames(batches, group, frame):
            if new:
                if state is not None and finish:
                    yield finish(state)
                state = start()
            out = step(state, part)
            if out is not None and len(out):
                yield out
        if state is not None and finish:
            yield finish(state)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated: adaptive execution would join them by bytes, into fewer tasks than cores
    return rows.repartition(parts, group).sortWithinPartitions(group, frame).mapInPandas(run, schema)
