"""Spans, fades and frame choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shifted_spans(spans: Column, offset: Column, scale: float = 1.0) -> Column:
    """Spans scaled and moved, rounded to milliseconds."""
    move = lambda v: F.bround(v * scale + offset, 3)
    return F.transform(spans, lambda s: s.withField("start_s", move(s["start_s"])).withField("end_s", move(s["end_s"])))


def clamped(start: Column, end: Column, low: Column, high: Column, scale: float = 1.0) -> Column:
    """An overlap cut to a window and counted from its start."""
    cut = lambda v: F.bround((F.greatest(low, F.least(v, high)) - low) * scale, 3)
    return F.struct(cut(start).alias("start_s"), cut(end).alias("end_s"))


def linear_fade(offset: Column, half: float, most: float) -> Column:
    """Decays from the centre to zero at ``half`` frames."""
    return F.greatest(F.lit(0.0), 1 - F.abs(offset) / half) * most


def trapezoid(offset: Column, fade_in: float, hold: float, fade_out: float, most: float = 1.0) -> Column:
    """Rises before the event, holds, falls."""
    up, down = (offset + fade_in) / fade_in, (hold + fade_out - offset) / fade_out
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), up, down)) * most


def speed_to_fit(duration: Column, slot: Column, most: float = 1.5) -> Column:
    """The speed that fits a clip into its slot; null when it would have to be too fast."""
    need = F.greatest(F.lit(1.0), duration / slot * 1.01)
    return F.when(need <= most, need)


def frame_bounds(first: Column, last: Column, frames: Column, margin: int) -> Column:
    """With a margin, inside the video."""
    return F.struct(F.greatest(F.lit(0), first - margin).alias("first"), F.least(frames - 1, last + margin).alias("last"))


def sampled_frames(length: Column, wanted: int) -> Column:
    """The middles of ``wanted`` equal intervals; short videos give all frames, padded with the last."""
    whole = F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)))
    # the interval k is [k * length // wanted, (k + 1) * length // wanted - 1]
    middles = F.transform(
        F.sequence(F.lit(0), F.lit(wanted - 1)),
        lambda k: F.floor((F.floor(k * length / wanted) + F.greatest(F.floor((k + 1) * length / wanted) - 1, F.floor(k * length / wanted))) / 2).cast("int"),
    )
    padded = F.concat(whole, F.array_repeat(F.greatest(length - 1, F.lit(0)), F.greatest(wanted - length, F.lit(0))))
    return F.when(length >= wanted, middles).otherwise(padded)
