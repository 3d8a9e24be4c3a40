"""Stream transformations: event time from frames, windows with late data, carried values, replays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(frame: Column, fps: float) -> Column:
    """Frames as timestamps from the epoch: streams of frames have no clock of their own."""
    return F.timestamp_millis((frame * 1000 / fps).cast("long"))


def every_kth(rows: DataFrame, frame: str, fps: int, target_fps: int) -> DataFrame:
    """Every fps // target_fps-th frame."""
    return rows.where(F.col(frame) % max(1, fps // target_fps) == 0)


def windowed_counts(rows: DataFrame, at: str, keys: list[str], value: str, length: str = "1 second", slide: str = "500 milliseconds", late: str = "5 seconds") -> DataFrame:
    """W03 over a stream: counts and sums of sliding windows; rows later than the watermark are dropped."""
    w = F.window(at, length, slide)
    out = rows.withWatermark(at, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def carried_stream(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """W15 over a stream: the last value so far that is not null, kept for each key between batches."""
    kinds = dict(rows.select(key, order, value).dtypes)

    def fold(name: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(order, kind="stable")
        last = held.get[0] if held.exists else None
        filled = pdf[value].astype(object).where(pdf[value].notna(), None)
        out = []
        for v in filled:
            last = v if v is not None else last
            out.append(last)
        if last is not None:
            held.update((last,))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], value: out})

    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{value}` {kinds[value]}"
    return rows.select(key, order, value).groupBy(key).applyInPandasWithState(fold, schema, f"last {kinds[value]}", "append", GroupStateTimeout.NoTimeout)


def without_replays(rows: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows that a restarted source sends again count once."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def to_table(rows: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch once; a batch that was written already is skipped after a restart."""

    def write(batch: DataFrame, number: int) -> None:
        target = f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
