"""Clean-up of propagated boxes outward from a prompt row, in both directions.

A track is walked from its prompt frame to lower frames and then to higher ones, as far as neighbouring
frames hold valid rows. A row of several pieces is clipped around the box of the row before it; a row
that is too large, or much larger than the two frames below it, is an outlier; an outlier or clipped
mask is opened and closed, and where nothing is left the row and all beyond it in that direction fail.

Rows are sorted by direction and distance from the prompt and folded in batches, so a task holds a
batch and the last few boxes of one track, never a whole track.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks
from . import frames

Box = tuple[float, float, float, float]


@dataclass(frozen=True)
class Limits:
    """How far a box may grow, and when it is an outlier; lengths are pixels, sizes are width plus height."""

    expansion: float = 1.0
    wider: float = 30.0
    higher: float = 60.0
    small: float = 125.0  # boxes below this size are not clipped
    usual: float = 150.0  # nor are those below this one outliers
    large: float = 500.0  # and all above this one are
    ratio: float = 1.4
    kernel: int = 5


def clipped(box: Box, before: Box | None, limits: Limits) -> Box | None:
    """``box`` cut at the largest box allowed around the centre of the one before it; None if nothing is to be cut."""
    if before is None or (box[2] - box[0]) + (box[3] - box[1]) < limits.small:
        return None
    half_w = ((before[2] - before[0]) * limits.expansion + limits.wider) / 2
    half_h = ((before[3] - before[1]) * limits.expansion + limits.higher) / 2
    x, y = (before[0] + before[2]) / 2, (before[1] + before[3]) / 2
    cut = (max(box[0], x - half_w), max(box[1], y - half_h), min(box[2], x + half_w), min(box[3], y + half_h))
    return None if cut == tuple(box) or cut[2] <= cut[0] or cut[3] <= cut[1] else cut


def outlying(box: Box | None, below: list[Box | None], limits: Limits) -> bool:
    """Whether a box is too large, or larger than the mean of the boxes below it; ``below`` is from the farthest, up to the first gap."""
    if box is None:
        return False
    w, h = box[2] - box[0], box[3] - box[1]
    if w + h > limits.large:
        return True
    known: list[Box] = []
    for b in below:
        if b is None:
            break
        known.append(b)
    if w + h < limits.usual or not known:
        return False
    mean_w, mean_h = np.mean([b[2] - b[0] for b in known]), np.mean([b[3] - b[1] for b in known])
    return bool((w > limits.ratio * mean_w if mean_w > 0 else False) or (h > limits.ratio * mean_h if mean_h > 0 else False))


def _boxed(mask: np.ndarray) -> Box | None:
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return (float(columns[0]), float(rows[0]), float(columns[-1]), float(rows[-1])) if len(rows) else None


class _Walk:
    """One track on its way: the state between batches."""

    def __init__(self, limits: Limits, shape: tuple[int, int] | None):
        self.limits, self.shape = limits, shape
        self.done: dict[int, Box | None] = {}  # processed rows around the prompt
        self.last, self.at, self.prompt = None, None, None
        self.open, self.failed, self.forward = True, False, False

    def one(self, row: dict, below: list[Box | None], before: Box | None) -> bool:
        """Clip, judge and clean one row in place; False where nothing is left of it."""
        box, cut = row["box"], None
        if row["pieces"] != 1 and box is not None:
            cut = clipped(box, before, self.limits)
        mask = masks.decode(row["mask"], *self.shape) if row["mask"] is not None and (cut or outlying(box, below, self.limits)) else None
        if cut:
            row["constrained"] = True
            if mask is not None:
                mask[:, : max(int(cut[0]), 0)] = False
                mask[: max(int(cut[1]), 0)] = False
                mask[:, int(cut[2]) :] = False
                mask[int(cut[3]) :] = False
                box = _boxed(mask)
            row["box"] = box if mask is not None and box is not None else tuple(float(int(v)) for v in cut)
        row["outlier"] = outlying(row["box"], below, self.limits)
        if mask is not None and (cut or row["outlier"]):
            cleaned = masks.cleaned(mask, self.limits.kernel)
            row["mask"] = masks.encode(cleaned if cleaned.any() else mask)
            row["box"] = _boxed(cleaned)
            if row["box"] is None:
                row["valid"] = False
                return False
        return True

    def step(self, row: dict) -> dict:
        forward, frame = row["forward"], row["frame"]
        if row["away"] == 0:
            self.prompt = dict(row)
            self.open = bool(row["valid"])
            if self.open:
                self.prompt["reached"] = True
                self.one(self.prompt, [row["below2"], row["below1"]], None)
                self.failed = not self.prompt["valid"]
                self.done[frame] = self.prompt["box"]
                self.last, self.at = self.prompt["box"], frame
            return {}
        if forward and not self.forward:
            self.turn()
        row["reached"] = self.open and bool(row["valid"]) and self.at is not None and abs(frame - self.at) == 1
        if not row["reached"]:
            self.open = False
            if not forward and row["away"] <= 2 and row["valid"]:
                self.done[frame] = row["box"]
            return row
        self.at = frame
        if self.failed:  # all beyond the first failure
            row["valid"], row["box"] = False, None
            return row
        below = [self.done.get(frame - 2), self.done.get(frame - 1)] if forward else [row["below2"], row["below1"]]
        self.failed = not self.one(row, below, self.last)
        self.last = row["box"]
        if forward or self.prompt["frame"] - frame <= 2:
            self.done[frame] = row["box"]
        if forward:
            self.done.pop(frame - 2, None)
        return row

    def turn(self) -> None:
        """Back to the prompt, which is judged once more with what is now below it, and on to higher frames."""
        self.forward = True
        if self.prompt is None or not self.prompt["reached"]:
            self.open = False
            return
        frame = self.prompt["frame"]
        self.open, self.at, self.failed = True, frame, False
        if self.prompt["valid"]:
            self.failed = not self.one(self.prompt, [self.done.get(frame - 2), self.done.get(frame - 1)], None)
        self.done[frame] = self.last = self.prompt["box"]


_ADDED = "box array<double>, valid boolean, constrained boolean, outlier boolean, reached boolean"


def clean_outward(rows: DataFrame, track: list[str], frame: str, prompt: str, limits: Limits = Limits(), shape: tuple[int, int] | None = None) -> DataFrame:
    """Track, frame, box, mask, valid, constrained, outlier, reached for every row.

    ``rows`` has box (ltrb), valid and ``prompt``, the frame that the track's walk begins at, and where
    they are known mask (run lengths of an image of ``shape``) and pieces (connected parts; a row of one
    part is not clipped, null counts as several). Rows that the walk does not reach, beyond a gap or an
    invalid row, stay as they are with reached false; a track without a valid row at its prompt is not
    walked. Without masks a clipped box is cut to whole pixels and no row fails. Of several rows of a
    track in one frame the first box is taken, in the order of its edges; rows without a frame go.
    """
    have = set(rows.columns)
    null = lambda kind: F.lit(None).cast(kind)
    key = F.to_json(F.struct(*(F.col(f"`{c}`") for c in track)), {"ignoreNullFields": "false"})
    base = rows.select(
        key.alias("track_key"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(track)), F.col(frame).cast("long").alias("frame"), F.col(prompt).cast("long").alias("prompt"),
        F.col("box").cast("array<double>").alias("box"), (F.coalesce("valid", F.lit(False)) & F.col("box").isNotNull()).alias("valid"),
        (F.col("mask") if "mask" in have else null("string")).alias("mask"), (F.col("pieces").cast("long") if "pieces" in have else null("long")).alias("pieces"),
    ).where("frame is not null")
    same = Window.partitionBy("track_key", "frame").orderBy(F.desc("valid"), "box", "mask")
    base = base.withColumn("no", F.row_number().over(same)).where("no = 1").drop("no")
    up = Window.partitionBy("track_key").orderBy("frame")
    below = lambda k: F.first(F.when(F.col("valid"), F.col("box"))).over(up.rangeBetween(-k, -k))
    base = base.withColumn("below1", below(1)).withColumn("below2", below(2))
    away = F.abs(F.col("frame") - F.col("prompt"))
    ahead = F.col("frame") > F.col("prompt")
    placed = base.withColumn("away", away).withColumn("forward", F.coalesce(ahead, F.lit(True)))
    # lower frames come first, by distance, then higher ones
    placed = placed.withColumn("place", F.col("forward").cast("long") * F.lit(1 << 60) + F.coalesce("away", F.col("frame")))
    names = [f"k{i}" for i in range(len(track))]
    kinds = dict(base.dtypes)
    out_schema = ", ".join(f"{n} {kinds[n]}" for n in names) + f", frame long, mask string, {_ADDED}"
    columns = [*names, "frame", "mask", "box", "valid", "constrained", "outlier", "reached"]

    def start() -> _Walk:
        return _Walk(limits, shape)

    def step(walk: _Walk, pdf: pd.DataFrame) -> pd.DataFrame | None:
        out = []
        for row in pdf.to_dict("records"):
            for c in ("box", "below1", "below2"):
                row[c] = tuple(row[c]) if row[c] is not None else None
            row["pieces"] = None if pd.isna(row["pieces"]) else int(row["pieces"])
            row.update(constrained=False, outlier=False, reached=False)
            got = walk.step(row)
            if got:
                out.append(got)
        return _frame(out) if out else None

    def finish(walk: _Walk) -> pd.DataFrame:
        if walk.prompt is not None and not walk.forward:
            walk.turn()
        return _frame([walk.prompt] if walk.prompt is not None else [])

    def _frame(out: list[dict]) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=columns)
        pdf["box"] = pd.Series([None if b is None else list(b) for b in pdf["box"]], dtype=object)
        return pdf

    needed = ["track_key", *names, "frame", "mask", "box", "valid", "pieces", "below1", "below2", "away", "forward", "place"]
    walked = frames.fold(placed.select(*needed), "track_key", "place", start, step, out_schema, finish)
    return walked.select(*(F.col(n).alias(c) for n, c in zip(names, track, strict=True)), F.col("frame").alias(frame), "box", "mask", "valid", "constrained", "outlier", "reached")
