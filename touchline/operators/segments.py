"""Segments of propagated masks against detections.

Masks are run lengths. Pixels that two masks share are found by joining their runs as intervals; no
mask is decoded. In a frame the segments take detections in the order in which they were propagated:
each by its best overlap among the free ones, else it is a duplicate of what is there already or new.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes, masks
from . import frames as in_frames
from .joins import interval_join

#: Pixels of a bin when runs are joined; runs are at most an image's column long, as a rule.
WIDTH = 2048


def run_rows(rows: DataFrame, keys: list[str], mask: str, begin: str, end: str) -> DataFrame:
    """keys and one row for each foreground run, from ``begin`` to before ``end``; null masks have none. Whole batches are cut at once."""
    one = rows.where(F.col(mask).isNotNull()).select(*keys, F.col(mask).alias("__mask"))
    schema = T.StructType([*one.select(*keys).schema.fields, T.StructField(begin, T.LongType()), T.StructField(end, T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, first, last = masks.run_table(batch.column(batch.schema.get_field_index("__mask")).to_pylist())
            kept = batch.select(keys).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(first), pa.array(last)], [*keys, begin, end])

    return one.mapInArrow(cut, schema)


def shared_pixels(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str, mask: str = "mask", ordered: bool = False) -> DataFrame:
    """Keys, a_id, b_id, common for masks of one image that share a pixel; with ``ordered`` only pairs where a_id is below b_id."""
    left = run_rows(a, [*keys, a_id], mask, "__a1", "__a2")
    right = run_rows(b, [*keys, b_id], mask, "__b1", "__b2")
    met = interval_join(left, right, ("__a1", "__a2"), ("__b1", "__b2"), WIDTH, keys)
    if ordered:
        met = met.where(F.col(a_id) < F.col(b_id))
    return met.groupBy(*keys, a_id, b_id).agg(F.sum(F.least("__a2", "__b2") - F.greatest("__a1", "__b1")).alias("common"))


def mask_track_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared pixels over pixels of either of two tracks of masks, summed over all frames; a and b have seq, id, t, mask.

    Pairs share at least a pixel of one frame; a track has one mask in a frame.
    """
    size = lambda df, name: df.groupBy("seq", "id").agg(F.sum(masks.area(F.col("mask"))).alias(name))
    x, y = a.withColumnRenamed("id", "a_id"), b.withColumnRenamed("id", "b_id")
    common = shared_pixels(x, y, ["seq", "t"], "a_id", "b_id").groupBy("seq", "a_id", "b_id").agg(F.sum("common").alias("i"))
    full = common.join(size(a, "sa").withColumnRenamed("id", "a_id"), ["seq", "a_id"]).join(size(b, "sb").withColumnRenamed("id", "b_id"), ["seq", "b_id"])
    return full.select("seq", "a_id", "b_id", (F.col("i") / (F.col("sa") + F.col("sb") - F.col("i"))).alias("iou"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def match_segments(
    segments: DataFrame, detections: DataFrame, keys: list[str], least_iou: float = 0.5, least_share: float = 0.7, mask_iou: float = 0.6, mask_share: float = 0.6, contained: float = 0.6
) -> DataFrame:
    """Keys, place, obj_id, det (null unless matched), outcome: 'matched', 'duplicate' or 'new' for each segment's row.

    ``keys`` name a frame. segments: place (a long, the order in which they were propagated, unique in a
    frame), obj_id, box, mask; detections: det (a long, their stored order, unique in a frame), box.

    A segment's row takes the free detection of largest IoU and that of which it covers itself most, if
    they are one and either measure is over its threshold; else the first, then the second, by its own
    threshold. Of equal ones the earlier detection is taken. A row that takes none is a duplicate if it
    contains several free detections, or if its mask overlaps that of a segment that matched, or was new,
    before it in the frame: by ``mask_iou`` or by ``mask_share`` of its own pixels, or at all where both
    have one obj_id. A null mask overlaps nothing; a matched one without a mask stands for its obj_id.
    """
    left = segments.select(*keys, "place", "obj_id", F.col("box").alias("a"), F.col("mask").isNotNull().alias("has_mask"))
    met = left.join(detections.select(*keys, "det", F.col("box").alias("b")), keys).withColumn("o", boxes.overlap(F.col("a"), F.col("b")))
    near = met.where("o.of_first > 0 or o.of_second > 0").groupBy(*keys, "place").agg(
        F.sort_array(F.collect_list(F.struct("det", "o.iou", F.col("o.of_first").alias("own"), F.col("o.of_second").alias("of_det")))).alias("near")
    )
    sized = segments.select(*keys, "place", masks.area(F.col("mask")).alias("area"))
    x, y = segments.select(*keys, F.col("place").alias("earlier"), "mask"), segments.select(*keys, "place", "mask")
    common = shared_pixels(x, y, keys, "earlier", "place", ordered=True)
    both = common.join(sized, [*keys, "place"]).join(sized.withColumnsRenamed({"place": "earlier", "area": "other"}), [*keys, "earlier"])
    i = F.col("common")
    close = both.groupBy(*keys, "place").agg(
        F.collect_list(F.struct("earlier", _share(i, F.col("area") + F.col("other") - i).alias("iou"), _share(i, F.col("area")).alias("own"))).alias("close")
    )
    full = left.drop("a").join(near, [*keys, "place"], "left").join(close, [*keys, "place"], "left")
    kinds = dict(full.dtypes)

    def cascade(pdf: pd.DataFrame, firsts: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(pdf))))
        rows = pdf.assign(__g=group).sort_values(["__g", "place"])
        out = []
        at = -1
        for g, row in zip(rows["__g"], rows[["place", "obj_id", "has_mask", "near", "close"]].itertuples(), strict=True):
            if g != at:
                at, taken = g, set()
                there: dict[int, tuple[int, bool, bool]] = {}  # place to (object, matched, has a mask)
            free = [d for d in (row.near if row.near is not None else []) if d["det"] not in taken]
            by_iou = max(free, key=lambda d: d["iou"], default=None)
            by_own = max(free, key=lambda d: d["own"], default=None)
            by_iou = by_iou if by_iou is not None and by_iou["iou"] > 0 else None
            by_own = by_own if by_own is not None and by_own["own"] > 0 else None
            iou_ok, own_ok = by_iou is not None and by_iou["iou"] > least_iou, by_own is not None and by_own["own"] > least_share
            same = by_iou is not None and by_own is not None and by_iou["det"] == by_own["det"]
            det = None
            if iou_ok or (same and own_ok):
                det = by_iou["det"]
            elif own_ok:
                det = by_own["det"]
            if det is not None:
                taken.add(det)
                there[row.place] = (row.obj_id, True, row.has_mask)
                out.append((row.place, row.obj_id, det, "matched"))
                continue
            twice = sum(d["of_det"] > contained for d in free) > 1
            twice = twice or any(matched and not has and obj == row.obj_id for obj, matched, has in there.values())
            for c in row.close if row.close is not None else []:
                if c["earlier"] in there:
                    twice = twice or c["iou"] > mask_iou or c["own"] > mask_share or there[c["earlier"]][0] == row.obj_id
            if not twice:
                there[row.place] = (row.obj_id, False, row.has_mask)
            out.append((row.place, row.obj_id, None, "duplicate" if twice else "new"))
        done = pd.DataFrame(out, columns=["place", "obj_id", "det", "outcome"]).astype({"det": "Int64"})
        for k in keys:
            done[k] = rows[k].to_numpy()
        return done[[*keys, "place", "obj_id", "det", "outcome"]]

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", place long, obj_id {kinds['obj_id']}, det long, outcome string"
    return in_frames.by_group(full, keys, cascade, schema)
