"""Cameras as column expressions: image points to the ground, world lines to what the image shows.

Matrices are arrays of rows. K is the 3 x 3 calibration, R the rotation from world to camera, the
position is that of the camera in the world, Rt the 3 x 4 matrix [R | t] and P = K Rt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import finite, inverse

#: Depth in front of the camera at which lines are cut: a fixed value.
NEAR = 0.1
#: Directions with a smaller share towards the ground are parallel to it.
FLAT = 1e-12


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _times(m: Column, v: list[Column], rows: int = 3) -> list[Column]:
    return [sum((m[i][j] * v[j] for j in range(1, len(v))), m[i][0] * v[0]) for i in range(rows)]


def _sound(point: Column) -> Column:
    return F.when(finite(point["x"]) & finite(point["y"]), point)


def ground_point(K: Column, R: Column, position: Column, u: Column, v: Column) -> Column:
    """Where the ray through an image point meets the plane z = 0, as struct x, y.

    Null where the ray is parallel to the ground, a matrix is singular, or a number is missing, NaN or
    infinite. A point that lies behind the camera is given like any other.
    """

    def meet(inverses: Column) -> Column:
        ray = _times(inverses["k"], [u.cast("double"), v.cast("double"), F.lit(1.0)])
        return _let(F.array(*_times(inverses["r"], ray)), lambda d: _let(F.when(F.abs(d[2]) > FLAT, -position[2] / d[2]), lambda s: F.struct((position[0] + s * d[0]).alias("x"), (position[1] + s * d[1]).alias("y"))))

    return _let(_let(F.struct(inverse(K).alias("k"), inverse(R).alias("r")), meet), _sound)


def ground_point_of(P: Column, u: Column, v: Column) -> Column:
    """The same from a projection matrix: the two equations of the image point with z = 0, null where they are dependent."""
    a = [[u * P[2][j] - P[0][j] for j in (0, 1)], [v * P[2][j] - P[1][j] for j in (0, 1)]]
    b = [P[0][3] - u * P[2][3], P[1][3] - v * P[2][3]]
    d = a[0][0] * a[1][1] - a[0][1] * a[1][0]
    point = F.struct(((b[0] * a[1][1] - a[0][1] * b[1]) / d).alias("x"), ((a[0][0] * b[1] - b[0] * a[1][0]) / d).alias("y"))
    return _let(F.when(F.abs(d) > FLAT, point), _sound)


def ground_box(of: Callable[[Column, Column], Column], box: Column) -> Column:
    """The lower edge of an ltrb box on the ground: left, right and middle; null if any of them is. ``of`` gives the ground point of (u, v)."""
    ends = {"left": box[0], "right": box[2], "middle": box[0] + (box[2] - box[0]) / 2}
    at = F.struct(*(of(x, box[3]).alias(k) for k, x in ends.items()))
    named = lambda p: F.struct(*(p[k][c].alias(f"{c}_bottom_{k}") for k in ends for c in ("x", "y")))
    return _let(at, lambda p: F.when(p["left"].isNotNull() & p["right"].isNotNull() & p["middle"].isNotNull(), named(p)))


def projection(K: Column, Rt: Column) -> Column:
    """P = K Rt as an array of rows."""
    return F.array(*(F.array(*(sum((K[i][k] * Rt[k][j] for k in (1, 2)), K[i][0] * Rt[0][j]) for j in range(4))) for i in range(3)))


def _seen(K: Column, p: Column, width: Column, height: Column) -> Column:
    """A point of the camera's frame in shares of the image; the centre of the image is added after the division, so it is not rounded with the rest."""
    at, depth = _times(K, [p["x"], p["y"]]), K[2][0] * p["x"] + K[2][1] * p["y"] + K[2][2] * p["z"]
    x, y = (at[i] / depth + K[i][2] * (p["z"] / depth) for i in (0, 1))
    return F.struct((x / width).alias("x"), (y / height).alias("y"))


def _in_camera(Rt: Column, p: Column) -> Column:
    x, y, z = _times(Rt, [p["x"], p["y"], p["z"], F.lit(1.0)])
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def clip_to_image(line: Column) -> Column:
    """The part of a segment (struct x1, y1, x2, y2 in shares of the image) within 0..1; null if there is none."""
    x, y, dx, dy = line["x1"], line["y1"], line["x2"] - line["x1"], line["y2"] - line["y1"]
    sides = F.array(*(F.struct(p.alias("p"), q.alias("q")) for p, q in ((-dx, x), (dx, 1 - x), (-dy, y), (dy, 1 - y))))

    def cut(s: Column) -> Column:
        outside = F.exists(s, lambda e: (e["p"] == 0) & (e["q"] < 0))
        enter = F.array_max(F.transform(s, lambda e: F.when(e["p"] < 0, F.greatest(e["q"] / e["p"], F.lit(0.0))).otherwise(0.0)))
        leave = F.array_min(F.transform(s, lambda e: F.when(e["p"] > 0, F.least(e["q"] / e["p"], F.lit(1.0))).otherwise(1.0)))
        part = lambda t: F.struct(*((v + t[k] * d).alias(n) for n, v, d, k in (("x1", x, dx, "a"), ("y1", y, dy, "a"), ("x2", x, dx, "b"), ("y2", y, dy, "b"))))
        return _let(F.struct(enter.alias("a"), leave.alias("b")), lambda t: F.when(~outside & (t["a"] <= t["b"]), part(t)))

    return _let(F.when(finite(x) & finite(y) & finite(dx) & finite(dy), sides), cut)


def visible_line(K: Column, Rt: Column, a: Column, b: Column, width: Column, height: Column) -> Column:
    """The segment from a to b (structs x, y, z of the world) as the image shows it, in shares of its size; null where nothing is seen.

    What lies nearer than ``NEAR`` in front of the camera, or behind it, is cut off first.
    """

    def cut(ends: Column) -> Column:
        p, q = ends["p"], ends["q"]
        t = (NEAR - p["z"]) / (q["z"] - p["z"])
        at = F.struct(*((p[c] + t * (q[c] - p[c])).alias(c) for c in ("x", "y")), F.lit(NEAR).alias("z"))
        near = lambda e: e["z"] <= NEAR
        both = F.struct(F.when(near(p), at).otherwise(p).alias("p"), F.when(near(q), at).otherwise(q).alias("q"))
        return F.when(~(near(p) & near(q)), both)

    def shown(ends: Column) -> Column:
        pair = F.struct(_seen(K, ends["p"], width, height).alias("p"), _seen(K, ends["q"], width, height).alias("q"))
        line = lambda e: F.struct(e["p"]["x"].alias("x1"), e["p"]["y"].alias("y1"), e["q"]["x"].alias("x2"), e["q"]["y"].alias("y2"))
        return _let(_let(pair, line), clip_to_image)

    ends = F.struct(_in_camera(Rt, a).alias("p"), _in_camera(Rt, b).alias("q"))
    return _let(_let(ends, cut), lambda e: F.when(e.isNotNull(), shown(e)))


def visible_points(K: Column, Rt: Column, points: Column, width: Column, height: Column, least: int = 3) -> Column:
    """The points of a curve (array of structs x, y, z) that lie in front of the camera and inside the image; null for fewer than ``least``."""
    there = F.filter(F.transform(points, lambda p: _in_camera(Rt, p)), lambda p: p["z"] > NEAR)
    inside = F.filter(F.transform(there, lambda p: _seen(K, p, width, height)), lambda s: s["x"].between(0, 1) & s["y"].between(0, 1))
    return _let(inside, lambda s: F.when(F.size(s) >= least, s))
