from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from touchline.functions import boxes, geometry, masks, text, timing


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def box(*v):
    return F.array(*(F.lit(float(x)) for x in v))


def test_box_conversions_round_trip(spark):
    b = box(10, 20, 30, 40)
    assert one(spark, boxes.ltwh_to_ltrb(b)) == [10, 20, 40, 60]
    assert one(spark, boxes.ltrb_to_ltwh(boxes.ltwh_to_ltrb(b))) == [10, 20, 30, 40]
    assert one(spark, boxes.ltwh_to_xywh(b)) == [25, 40, 30, 40]
    assert one(spark, boxes.xywh_to_ltwh(boxes.ltrb_to_xywh(boxes.ltwh_to_ltrb(b)))) == [10, 20, 30, 40]
    assert one(spark, boxes.rounded(box(0.5, 1.5, 2.5, 3.2))) == [0, 2, 2, 3]


def test_sanitized_boxes_stay_inside(spark):
    got = one(spark, boxes.sanitized_ltwh(box(-5, 700, 5000, 0), F.lit(1280.0), F.lit(720.0)))
    assert got == [0, 700, 1279, 1]
    assert one(spark, boxes.sanitized_ltrb(box(-5, -1, 2000, 900), F.lit(1280.0), F.lit(720.0))) == [0, 0, 1279, 719]


def test_overlap_measures(spark):
    a, b, far = box(0, 0, 10, 10), box(5, 0, 15, 10), box(20, 0, 30, 10)
    assert one(spark, boxes.iou(a, b)) == pytest.approx(1 / 3)
    assert one(spark, boxes.ioa(a, b)) == pytest.approx(0.5)
    assert one(spark, boxes.iou(a, box(3, 3, 3, 3))) == 0
    assert one(spark, boxes.giou(a, far)) == pytest.approx(-1 / 3)
    assert one(spark, boxes.diou(a, a)) == 1
    assert one(spark, boxes.ciou(a, a)) == pytest.approx(1)
    assert one(spark, boxes.overlap(a, F.lit(None).cast("array<double>")))["iou"] == 0
    assert one(spark, boxes.gated(F.lit(3.0), 2.0)) is None


def test_keypoints(spark):
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(c).alias("c")) for x, y, c in ((1.0, 2.0, 0.9), (5.0, 10.0, 0.5), (99.0, 99.0, 0.0))))
    assert one(spark, boxes.box_of_keypoints(points)) == [1, 2, 4, 8]
    inside = one(spark, boxes.keypoints_in_box(points, box(0, 0, 4, 4)))
    assert [tuple(p) for p in inside] == [(1, 2, 0.9), (0, 0, 0), (0, 0, 0)]


def test_homography_inverse_and_projection(spark):
    h = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in ((2, 0, 1), (0, 4, 2), (0, 0, 1))))
    p = one(spark, geometry.project(h, F.lit(3.0), F.lit(5.0)))
    assert tuple(p) == (7, 22)
    back = one(spark, geometry.project(geometry.inverse(h), F.lit(7.0), F.lit(22.0)))
    assert tuple(back) == pytest.approx((3, 5))
    singular = F.array(*(F.array(*(F.lit(1.0) for _ in range(3))) for _ in range(3)))
    assert one(spark, geometry.inverse(singular)) is None
    assert one(spark, geometry.pitch_box(geometry.inverse(h), box(0, 0, 2, 2)))["x_bottom_middle"] == pytest.approx(0)


def test_finite_and_matrix_checks(spark):
    assert one(spark, geometry.finite(F.lit(float("nan")))) is False
    assert one(spark, geometry.finite(F.lit(None).cast("double"))) is False
    assert one(spark, geometry.finite(F.lit(1))) is True
    assert one(spark, geometry.valid_matrix(F.lit(None).cast("array<array<double>>"))) is False


def test_rotation_round_trip(spark):
    r = geometry.orientation(F.lit(0.3), F.lit(1.2), F.lit(0.1))
    got = one(spark, geometry.pan_tilt_roll(r))
    assert tuple(got) == pytest.approx((0.3, 1.2, 0.1))


def test_segment_distance_clamps(spark):
    d = geometry.segment_distance(*(F.lit(float(x)) for x in (5, 3, 0, 0, 4, 0)))
    assert one(spark, d) == pytest.approx(10**0.5)


@pytest.mark.parametrize("title, tokens", [("03. Premium Counter_attack - Ajax — 2015", ["Counter attack", "Ajax", "2015"]), ("A - A", ["A"]), ("", [])])
def test_title_tokens(spark, title, tokens):
    assert one(spark, text.title_tokens(F.lit(title))) == tokens


def test_label_rules(spark):
    rules = [("press", "tactic"), ("corner", "event")]
    assert one(spark, text.first_match(F.lit("High PRESS corner"), rules, "context")) == "tactic"
    assert one(spark, text.first_match(F.lit("x"), rules, "context")) == "context"
    assert tuple(one(spark, text.name_and_year(F.lit("Ajax - final 2015.mp4")))) == ("ajax", "2015")


def test_replies(spark):
    assert one(spark, text.digits(F.lit("No. 1 and 0"))) == "10"
    assert one(spark, text.digits(F.lit("10?"))) is None
    assert one(spark, text.known_role(F.lit(" Player "), ["player"])) == "player"
    assert one(spark, text.bare_json(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, text.bare_json(F.lit("[1]"))) is None
    assert tuple(one(spark, text.parsed_window(F.lit("1.5:4")))) == (1.5, 4.0)
    assert one(spark, text.parsed_window(F.lit("4:1"))) is None
    assert one(spark, text.older_than(F.lit("1.2"), 1, 3)) and not one(spark, text.older_than(F.lit("1.3"), 1, 3)) and one(spark, text.older_than(F.lit("x"), 1, 3))


def test_category_and_unknown_role(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    assert one(spark, text.category(*lit("player", "left", "10"))) == "player_left_10"
    assert one(spark, text.category(*lit("goalkeeper", "right", None))) == "goalkeeper_right"
    assert one(spark, text.category(*lit("ball", None, None))) == "ball"
    with pytest.raises(Exception, match="unknown role"):
        one(spark, text.category(*lit("coach", None, None)))


def test_timing(spark):
    assert one(spark, timing.linear_fade(F.lit(5.0), 10.0, 1.0)) == 0.5
    assert one(spark, timing.linear_fade(F.lit(20.0), 10.0, 1.0)) == 0
    assert one(spark, timing.speed_to_fit(F.lit(10.0), F.lit(5.0))) is None
    assert one(spark, timing.sampled_frames(F.lit(3), 5)) == [0, 1, 2, 2, 2]
    assert one(spark, timing.sampled_frames(F.lit(10), 5)) == [0, 2, 4, 6, 8]
    assert tuple(one(spark, timing.clamped(F.lit(1.0), F.lit(9.0), F.lit(2.0), F.lit(5.0)))) == (0, 3)
    assert tuple(one(spark, timing.frame_bounds(F.lit(1), F.lit(8), F.lit(10), 3))) == (0, 9)


def test_masks(spark):
    import numpy as np

    m = np.zeros((4, 5), bool)
    m[1:3, 1:4] = True
    n = np.roll(m, 1, axis=1)
    assert (masks.decode(masks.encode(m), 4, 5) == m).all() and (masks.decode(masks.encode(~m), 4, 5) == ~m).all()
    df = spark.createDataFrame([(masks.encode(m), masks.encode(n), 4, 5)], "a string, b string, h int, w int")
    row = df.select(masks.area(F.col("a")).alias("area"), masks.mask_iou("a", "b", "h", "w").alias("iou"), masks.box_of_mask("a", "h", "w").alias("box"), masks.runs(F.col("a")).alias("runs")).first()
    assert (row["area"], row["iou"], row["box"]) == (6, 0.5, [1.0, 1.0, 3.0, 2.0])
    assert [tuple(r) for r in row["runs"]] == [(5, 7), (9, 11), (13, 15)]
    two = np.array([[1, 1, 0], [0, 0, 0], [0, 1, 1]], bool)
    assert masks.component_sizes(two) == [2, 2]
