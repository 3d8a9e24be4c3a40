"""Boxes as array<double> columns of four: conversions, clipping, overlap measures."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _four(box: Column) -> tuple[Column, Column, Column, Column]:
    return box[0], box[1], box[2], box[3]


def ltwh_to_ltrb(box: Column) -> Column:
    """Left, top, width, height to left, top, right, bottom."""
    l, t, w, h = _four(box)
    return F.array(l, t, l + w, t + h)


def ltwh_to_xywh(box: Column) -> Column:
    """To centre, width, height."""
    l, t, w, h = _four(box)
    return F.array(l + w / 2, t + h / 2, w, h)


def ltrb_to_ltwh(box: Column) -> Column:
    """N01."""
    l, t, r, b = _four(box)
    return F.array(l, t, r - l, b - t)


def ltrb_to_xywh(box: Column) -> Column:
    """N01."""
    return ltwh_to_xywh(ltrb_to_ltwh(box))


def xywh_to_ltwh(box: Column) -> Column:
    """Centre form to corner form."""
    x, y, w, h = _four(box)
    return F.array(x - w / 2, y - h / 2, w, h)


def xywh_to_ltrb(box: Column) -> Column:
    """N01."""
    return ltwh_to_ltrb(xywh_to_ltwh(box))


def rounded(box: Column) -> Column:
    """Half-even rounding of all four."""
    return F.transform(box, lambda v: F.bround(v, 0))


def _clip(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(v, high))


def sanitized_ltwh(box: Column, width: Column, height: Column) -> Column:
    """Corner inside the image with two pixels to spare, size at least one and inside."""
    l, t, w, h = _four(box)
    zero, one = F.lit(0.0), F.lit(1.0)
    left, top = _clip(l, zero, width - 2), _clip(t, zero, height - 2)
    return F.array(left, top, _clip(w, one, width - 1 - left), _clip(h, one, height - 1 - top))


def sanitized_ltrb(box: Column, width: Column, height: Column) -> Column:
    """Each edge on its own."""
    l, t, r, b = _four(box)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(_clip(l, zero, width - 2), _clip(t, zero, height - 2), _clip(r, one, width - 1), _clip(b, one, height - 1))


def clipped_ltrb(box: Column, width: Column, height: Column) -> Column:
    """Inside the image."""
    l, t, r, b = _four(box)
    zero = F.lit(0.0)
    return F.array(_clip(l, zero, width), _clip(t, zero, height), _clip(r, zero, width), _clip(b, zero, height))


def outward(box: Column) -> Column:
    """To whole pixels, left and top down, right and bottom up."""
    l, t, r, b = _four(box)
    return F.array(F.floor(l), F.floor(t), F.ceil(r), F.ceil(b))


def centre(box: Column) -> Column:
    """Midpoint of an ltrb box; null stays null."""
    l, t, r, b = _four(box)
    return F.when(box.isNotNull(), F.array((l + r) / 2, (t + b) / 2))


def area(box: Column) -> Column:
    l, t, r, b = _four(box)
    return F.greatest(r - l, F.lit(0.0)) * F.greatest(b - t, F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of ltrb boxes; 0 where both are degenerate."""
    common = intersection(a, b)
    return _ratio(common, area(a) + area(b) - common)


def ioa(a: Column, b: Column) -> Column:
    """Intersection over the area of the first box."""
    return _ratio(intersection(a, b), area(a))


def overlap(a: Column, b: Column) -> Column:
    """Iou and the shares of either box; a null box gives zeros."""
    null = a.isNull() | b.isNull()
    zero = lambda c: F.when(null, 0.0).otherwise(c)
    return F.struct(zero(iou(a, b)).alias("iou"), zero(ioa(a, b)).alias("of_first"), zero(ioa(b, a)).alias("of_second"))


def hull(a: Column, b: Column) -> Column:
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def giou(a: Column, b: Column) -> Column:
    """Generalised iou, from -1 to 1."""
    common, both = intersection(a, b), area(hull(a, b))
    union = area(a) + area(b) - common
    return iou(a, b) - _ratio(both - union, both)


def _offset(a: Column, b: Column) -> Column:
    ca, cb = centre(a), centre(b)
    return F.pow(ca[0] - cb[0], F.lit(2)) + F.pow(ca[1] - cb[1], F.lit(2))


def _diagonal(box: Column) -> Column:
    return F.pow(box[2] - box[0], F.lit(2)) + F.pow(box[3] - box[1], F.lit(2))


def diou(a: Column, b: Column) -> Column:
    """Iou less the squared centre distance over the squared hull diagonal."""
    return iou(a, b) - _ratio(_offset(a, b), _diagonal(hull(a, b)))


def ciou(a: Column, b: Column) -> Column:
    """Diou less the weighted difference of aspect ratios."""
    angle = lambda x: F.atan((x[2] - x[0]) / (x[3] - x[1]))
    v = 4 / math.pi**2 * F.pow(angle(a) - angle(b), F.lit(2))
    return diou(a, b) - _ratio(v * v, (1 - iou(a, b)) + v)


def unit_scaled(score: Column) -> Column:
    """From -1..1 to 0..1, as associations use it."""
    return (score + 1) / 2


def centre_distance(a: Column, b: Column) -> Column:
    """Distance of midpoints."""
    return F.sqrt(_offset(a, b))


def gated(distance: Column, limit: float) -> Column:
    """Null beyond the limit."""
    return F.when(distance <= limit, distance)


def fused_score(cost: Column, score: Column) -> Column:
    """IoU cost weighed by detection score."""
    return 1 - (1 - cost) * score


def fused_iou(appearance_cost: Column, iou_cost: Column) -> Column:
    """Appearance similarity weighed by overlap."""
    return 1 - (1 - appearance_cost) * (1 + (1 - iou_cost)) / 2


def box_of_keypoints(points: Column, extension: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Column:
    """Ltwh around keypoints (array of structs x, y, c) with c > 0, extended left/right, above and below."""
    seen = F.filter(points, lambda p: p["c"] > 0)
    xs, ys = F.transform(seen, lambda p: p["x"]), F.transform(seen, lambda p: p["y"])
    w, h = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    side, top, bottom = extension
    return F.when(
        F.size(seen) > 0, F.array(F.array_min(xs) - side * w, F.array_min(ys) - top * h, w * (1 + 2 * side), h * (1 + top + bottom))
    )


def keypoints_in_box(points: Column, box: Column) -> Column:
    """Relative to an ltwh box; those outside become zeros."""
    inside = lambda p: (p["x"] >= box[0]) & (p["y"] >= box[1]) & (p["x"] < box[0] + box[2]) & (p["y"] < box[1] + box[3])
    zero = F.lit(0.0)
    return F.transform(
        points,
        lambda p: F.struct(
            F.when(inside(p), p["x"] - box[0]).otherwise(zero).alias("x"), F.when(inside(p), p["y"] - box[1]).otherwise(zero).alias("y"),
            F.when(inside(p), p["c"]).otherwise(zero).alias("c"),
        ),
    )


def rescaled_keypoints(points: Column, sx: Column, sy: Column) -> Column:
    """Other size, same confidence."""
    return F.transform(points, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y"), p["c"].alias("c")))


#: Ways from one form of a box to another.
_FORMS = {
    ("ltwh", "ltrb"): ltwh_to_ltrb, ("ltwh", "xywh"): ltwh_to_xywh, ("ltrb", "ltwh"): ltrb_to_ltwh, ("ltrb", "xywh"): ltrb_to_xywh, ("xywh", "ltwh"): xywh_to_ltwh, ("xywh", "ltrb"): xywh_to_ltrb,
}


def seen_as(box: Column, have: str, want: str, width: Column | None = None, height: Column | None = None, whole: bool = False) -> Column:
    """A box in another form, within the image if its size is given, in whole pixels on demand."""
    if have not in ("ltwh", "ltrb", "xywh") or want not in ("ltwh", "ltrb", "xywh"):
        raise ValueError(f"boxes are ltwh, ltrb or xywh, not {have} or {want}")
    out = box if have == want else _FORMS[have, want](box)
    if width is not None and height is not None:
        inside = clipped_ltrb(out if want == "ltrb" else _FORMS[want, "ltrb"](out), width, height)
        out = inside if want == "ltrb" else _FORMS["ltrb", want](inside)
    return rounded(out) if whole else out


def visible_points(points: Column, least: float = 0.0) -> Column:
    """The keypoints (structs x, y, c) whose confidence is above ``least``."""
    return F.filter(points, lambda p: p["c"] > least)


def mean_confidence(points: Column) -> Column:
    """The mean confidence of the keypoints; null without any."""
    return F.try_divide(F.aggregate(points, F.lit(0.0), lambda s, p: s + p["c"]), F.size(points))
