"""Homographies, cameras and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """a number, not NaN and not infinite; null is not finite."""
    v = value.cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def valid_matrix(h: Column) -> Column:
    """three rows of three finite numbers."""
    return F.coalesce((F.size(h) == 3) & F.forall(h, lambda row: (F.size(row) == 3) & F.forall(row, finite)), F.lit(False))


def determinant(h: Column) -> Column:
    m = lambda i, j: h[i][j]
    return (
        m(0, 0) * (m(1, 1) * m(2, 2) - m(1, 2) * m(2, 1))
        - m(0, 1) * (m(1, 0) * m(2, 2) - m(1, 2) * m(2, 0))
        + m(0, 2) * (m(1, 0) * m(2, 1) - m(1, 1) * m(2, 0))
    )


def inverse(h: Column) -> Column:
    """The inverse of a 3x3 matrix; null when it is no valid matrix or singular."""
    d = determinant(h)

    def cofactor(i: int, j: int) -> Column:
        r, c = [x for x in range(3) if x != j], [x for x in range(3) if x != i]
        minor = h[r[0]][c[0]] * h[r[1]][c[1]] - h[r[0]][c[1]] * h[r[1]][c[0]]
        return (minor if (i + j) % 2 == 0 else -minor) / d

    rows = F.array(*(F.array(*(cofactor(i, j) for j in range(3))) for i in range(3)))
    return F.when(valid_matrix(h) & (d != 0), rows)


def project(h: Column, x: Column, y: Column, least: float = 1e-9) -> Column:
    """(x, y) under a homography with perspective divide; null where |w| is below ``least``."""
    w = h[2][0] * x + h[2][1] * y + h[2][2]
    px, py = (h[0][0] * x + h[0][1] * y + h[0][2]) / w, (h[1][0] * x + h[1][1] * y + h[1][2]) / w
    return F.when(F.abs(w) >= least, F.struct(px.alias("x"), py.alias("y")))


def pitch_box(h_inverse: Column, box_ltwh: Column) -> Column:
    """The bottom edge of an image box on the pitch; null for a singular camera."""
    left, top, width, height = (box_ltwh[i] for i in range(4))
    bottom = top + height
    ends = {"left": left, "middle": left + width / 2, "right": left + width}
    at = {k: project(h_inverse, x, bottom) for k, x in ends.items()}
    fields = [at[k][axis].alias(f"{axis}_bottom_{k}") for k in ends for axis in ("x", "y")]
    some_null = at["left"].isNull() | at["middle"].isNull() | at["right"].isNull()
    return F.when(h_inverse.isNotNull() & ~some_null, F.struct(*fields))


def sane_pitch_box(box: Column) -> Column:
    """Null unless both foot coordinates are finite."""
    return F.when(finite(box["x_bottom_middle"]) & finite(box["y_bottom_middle"]), box)


def foot_point(box: Column) -> Column:
    """P10: rounded centre of the lower edge of an image box struct; null if any part is missing."""
    x, y = F.bround(box["x_center"], 0), F.bround(box["y"] + box["h"], 0)
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def image_box(ltwh: Column) -> Column:
    """Array of four to a struct with centres; another size gives null."""
    l, t, w, h = (ltwh[i] for i in range(4))
    fields = {"x": l, "y": t, "w": w, "h": h, "x_center": l + w / 2, "y_center": t + h / 2}
    return F.when(F.size(ltwh) == 4, F.struct(*(v.alias(k) for k, v in fields.items())))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """N11."""
    return F.hypot(x1 - x2, y1 - y2)


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment, clamped to its ends."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    s = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length))).otherwise(0.0)
    return F.hypot(px - (x1 + s * dx), py - (y1 + s * dy))


def orientation(pan: Column, tilt: Column, roll: Column) -> Column:
    """Rotation matrix of pan, tilt and roll in radians: roll after tilt after pan."""
    cp, sp, ct, st, cr, sr = F.cos(pan), F.sin(pan), F.cos(tilt), F.sin(tilt), F.cos(roll), F.sin(roll)
    return F.array(
        F.array(cp * cr - sp * sr * ct, sp * cr + cp * sr * ct, sr * st),
        F.array(-cp * sr - sp * cr * ct, -sp * sr + cp * cr * ct, cr * st),
        F.array(sp * st, -cp * st, ct),
    )


def pan_tilt_roll(rotation: Column) -> Column:
    """The angles of a rotation matrix."""
    tilt = F.acos(rotation[2][2])
    return F.struct(F.atan2(rotation[2][0], -rotation[2][1]).alias("pan"), tilt.alias("tilt"), F.atan2(rotation[0][2], rotation[1][2]).alias("roll"))


def mirrored(lines: Column, opposite: dict[str, str]) -> Column:
    """Line classes renamed to their mirror images."""
    pairs = F.create_map(*(F.lit(x) for pair in opposite.items() for x in pair))
    return F.transform_keys(lines, lambda k, _: F.coalesce(pairs[k], k))
