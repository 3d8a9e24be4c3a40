"""Gates, ignore regions, distractors and look-ups on small rows, against brute force where there is a choice."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import preparation as P


def _polygon(*points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def _box(*edges):
    return F.array(*(F.lit(float(e)) for e in edges))


@pytest.mark.parametrize(
    ("polygon", "box", "area"),
    [
        ([(0, 0), (10, 0), (0, 10)], (0, 0, 10, 10), 50.0),
        ([(0, 0), (10, 0), (0, 10)], (5, 5, 9, 9), 0.0),
        ([(0, 0), (0, 10), (10, 0)], (0, 0, 5, 5), 25.0),
        ([(0, 0), (10, 0), (10, 10), (5, 2), (0, 10)], (0, 0, 10, 10), 60.0),
        ([(0, 0), (4, 0)], (0, 0, 10, 10), 0.0),
        ([(20, 20), (30, 20), (30, 30)], (0, 0, 10, 10), 0.0),
    ],
)
def test_overlap_with_polygon(spark, polygon, box, area):
    row = spark.range(1).select(P.overlap_with_polygon(_polygon(*polygon), _box(*box)).alias("a")).first()
    assert row.a == pytest.approx(area)


def test_ignored_without_regions(spark):
    rows = spark.range(2).select(F.col("id").alias("image"), _box(0, 0, 10, 10).alias("box"))
    regions = spark.range(1).select(F.col("id").alias("image"), _polygon((0, 0), (20, 0), (20, 9.5), (0, 9.5)).alias("polygon"))
    assert {r.image: r.ignored for r in P.ignored(rows, regions, "image", "box").collect()} == {0: True, 1: False}
    assert not P.ignored(rows, regions.limit(0), "image", "box").where("ignored").count()


def _dropped(truths, preds, least):
    """Predictions that go, by trying every assignment: most pairs first, then least cost."""

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        common = max(w, 0) * max(h, 0)
        return common / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common)

    padded = [*range(len(preds)), *([None] * len(truths))]
    best = None
    for order in set(itertools.permutations(padded, len(truths))):
        pairs = [(t, p) for t, p in enumerate(order) if p is not None and iou(truths[t][1], preds[p][1]) >= least]
        score = (len(pairs), -sum(1 - iou(truths[t][1], preds[p][1]) for t, p in pairs))
        if best is None or score > best[0]:
            best = score, pairs
    return {preds[p][0] for t, p in best[1] if truths[t][2]}


def test_distractors_against_every_assignment(spark):
    rng = random.Random(7)
    truth, pred, kept = [], [], set()
    for frame in range(12):
        place = lambda: [x := rng.uniform(0, 8), y := rng.uniform(0, 8), x + 20 + rng.random(), y + 20 + rng.random()]
        ts = [(k, place(), rng.random() < 0.5) for k in range(rng.randint(0, 3))]
        ps = [(k, place()) for k in range(rng.randint(0, 3))]
        truth += [(frame, k, b, d) for k, b, d in ts]
        pred += [(frame, k, b) for k, b in ps]
        gone = _dropped(ts, ps, 0.5)
        kept |= {(frame, k) for k, _ in ps if k not in gone}
    t = spark.createDataFrame(truth, "frame long, truth_id long, box array<double>, distractor boolean")
    p = spark.createDataFrame(pred, "frame long, pred_id long, box array<double>")
    assert {(r.frame, r.pred_id) for r in P.without_distractors(p, t).collect()} == kept
    assert P.without_distractors(p, t.limit(0)).count() == len(pred)


def test_keypoint_similarity(spark):
    def value(points, other, kappas=(0.1, 0.2)):
        of = lambda some: F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(p, "xyc", strict=True))) for p in some))
        return spark.range(1).select(P.keypoint_similarity(of(points), of(other), list(kappas)).alias("s")).first().s

    pair = [(0, 0, 1), (10, 10, 1)]
    assert value(pair, pair) == pytest.approx(1.0)
    assert value(pair, [(1, 0, 1), (10, 10, 0)]) == pytest.approx((math.exp(-1 / (2 * 100 * 0.01)) + 1) / 2)
    assert value([(0, 0, 0), (1, 1, 0)], pair) is None
    assert value([(0, 0, 1), (0, 9, 1)], pair) is None  # without width there is no scale


def test_attacking_team_ties_and_far_balls(spark):
    players = [("v", 0, 1, "left", 0.0, 0.0, 1.0, 0), ("v", 0, 1, "left", 90.0, 0.0, 0.5, 1), ("v", 1, 2, "right", 0.0, 0.0, 1.0, 2), ("w", 0, 3, "left", 0.0, 0.0, 1.0, 3)]
    p = spark.createDataFrame(players, "video string, frame long, track_id long, team string, x double, y double, score double, pos long")
    b = spark.createDataFrame([("v", 0, 1.0, 0.0), ("v", 1, 1.0, 0.0), ("w", 0, 50.0, 0.0)], "video string, frame long, x double, y double")
    assert [tuple(r) for r in P.attacking_team(p, b).collect()] == [("v", "left", 1)]


def test_look_ups(spark):
    frames = spark.range(2).withColumnRenamed("id", "frame")
    notes = spark.createDataFrame([(0, 2, "b"), (0, 1, "a")], "frame long, pos long, name string")
    out = {r.frame: [a.name for a in r.annotations] for r in P.frame_annotations(frames, notes, "frame", "pos").collect()}
    assert out == {0: ["a", "b"], 1: []}
    calls = spark.createDataFrame([(429, None), (503, "X"), (404, "X"), (None, "ReadTimeout"), (None, None)], "status int, name string")
    assert [r.again for r in calls.select(P.retryable(F.col("status"), F.col("name")).alias("again")).collect()] == [True, True, False, True, False]
    cards = spark.createDataFrame([(1, "P0", None), (2, "P3", "ok"), (3, " P2 ", "unverified"), (4, None, None)], "id long, p string, s string")
    assert [r.id for r in P.active_cards(cards, "p", "s").collect()] == [1]
