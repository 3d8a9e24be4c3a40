"""Stages by level, evaluators, indexes, documents, assignments as joins, parts of bodies."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.evaluation import detection
from touchline.functions import boxes, text
from touchline.operators import ranking
from touchline.plans import stage, topology
from touchline.sources import readers, versions, writers
from touchline.streaming import trackers


def test_stages_of_three_levels(spark):
    rows = [("v", f"i{k // 4}", k, float(k)) for k in range(12)]
    tables = {"detections": spark.createDataFrame(rows, "video_id string, image_id string, det_id long, x double").repartition(3)}
    twice = stage.detections_stage("twice", lambda b: b.assign(y=b["x"] * 2), ["x"], {"y": "double"}, where=F.col("x") > 2)
    rank = stage.images_stage("rank", lambda b: b.assign(r=b["y"].rank(na_option="keep")), ["y"], {"r": "double"})
    whole = stage.videos_stage("sum", lambda t: t.join(t.groupBy("video_id").agg(F.sum("y").alias("s")), "video_id"), ["y"], {"s": "double"})
    out = stage.run_stages([twice, rank, whole], tables)
    got = {r["det_id"]: (r["y"], r["r"], r["s"]) for r in out["detections"].collect()}
    total = float(sum(2 * k for k in range(3, 12)))
    assert got[1] == (None, None, total) and got[3] == (6.0, 1.0, total) and got[7] == (14.0, 4.0, total) and len(got) == 12
    with pytest.raises(ValueError, match="rank needs"):
        stage.run_stages([rank], tables)
    # a second run over other rows keeps what is there
    again = stage.step(out["detections"], "det_id", {"y": "double"}, lambda t: t.withColumn("y", F.lit(-1.0)), F.col("x") <= 2)
    assert {r["det_id"]: r["y"] for r in again.collect()}[1] == -1.0 and {r["det_id"]: r["y"] for r in again.collect()}[5] == 10.0
    e = stage.Evaluator("count", lambda t: t["detections"].groupBy("video_id").count(), {"detections": ["video_id"]})
    assert stage.evaluated([e], out)["count"].first()["count"] == 12
    with pytest.raises(ValueError, match="worse needs"):
        stage.evaluated([stage.Evaluator("worse", lambda t: t["x"], {"detections": ["nothing"]})], out)
    assert stage.forgotten(out, {"detections": ["y", "never"]})["detections"].columns == ["video_id", "image_id", "det_id", "x", "r", "s"]


def test_indexes_and_public_rows(spark):
    images = spark.createDataFrame([("a", "img1/000003.jpg"), ("b", "000004.png"), ("c", "none.jpg")], "image_id string, file_name string")
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "z"), ("c", 1, "w")], "image_id string, pos long, name string")
    got = {r["frame"]: [x["name"] for x in r["annotations"]] for r in readers.predictions_index(images, rows).collect()}
    assert got == {3: ["z", "y"], 4: []}
    df = spark.createDataFrame([(1, 2, 0.5)], "det_id long, track_id long, bbox_conf double")
    assert readers.public_detections(df, ["det_id", "track_id", "bbox_conf", "more"]).columns == ["det_id", "bbox_conf"]


def test_documents_and_details(spark, tmp_path):
    a = spark.createDataFrame([("v", 10, 1.5), ("v", 9, None), ("w", 1, 2.0)], "video_id string, id long, x double")
    b = spark.createDataFrame([("v", "100", "cam")], "video_id string, id string, kind string")
    docs = writers.evaluation_documents(a.withColumn("id", F.col("id").cast("string")), b)
    writers.write_evaluation_documents(docs, str(tmp_path / "d"))
    back = {r["video_id"]: json.loads(r["value"])["predictions"] for r in spark.read.text(str(tmp_path / "d")).collect()}
    assert back == {"v": [{"id": "10", "x": 1.5}, {"id": "100", "kind": "cam"}, {"id": "9"}], "w": [{"id": "1", "x": 2.0}]}
    for name, columns in (("one", ["HOTA", "IDF1"]), ("two", ["HOTA"])):
        df = spark.createDataFrame([("s1", c, 0.5 + len(name)) for c in columns], "seq string, field string, value double")
        writers.write_wide_summary(df, ["seq"], "field", "value", str(tmp_path / name))
    got = readers.metric_details(spark, {n: str(tmp_path / n) for n in ("one", "two")})
    assert sorted((r["tracker"], r["field"], r["value"]) for r in got.collect()) == [("one", "HOTA", 3.5), ("one", "IDF1", 3.5), ("two", "HOTA", 3.5)]


def test_files_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    versions.replace_file(spark, path, '{"a": "ä"}')
    versions.replace_file(spark, path, '{"b": 2}')
    assert (tmp_path / "x.json").read_text() == '{"b": 2}' and not (tmp_path / "x.json.part").exists()


def test_paths(spark):
    df = spark.createDataFrame([("a/b.mp4",), ("a.b/c",), (".hidden",), ("x.tar.gz",)], "p string")
    assert [tuple(r) for r in df.select(text.display_path(F.col("p"), "Lib"), text.result_path(F.col("p"))).collect()] == [
        ("Lib/a/b.mp4", "analysis/a/b.json"), ("Lib/a.b/c", "analysis/a.b/c.json"), ("Lib/.hidden", "analysis/.hidden.json"), ("Lib/x.tar.gz", "analysis/x.tar.json"),
    ]


def test_assignments_as_joins(spark):
    rng = random.Random(4)
    rows = [(g, i, j, rng.randint(0, 2), rng.random()) for g in range(8) for i in range(rng.randint(1, 4)) for j in range(rng.randint(1, 4)) if rng.random() < 0.8]
    ages = {(g, i): a for g, i, _, a, _ in rows}
    rows = [(g, i, j, ages[g, i], c) for g, i, j, _, c in rows]
    df = spark.createDataFrame(rows, "g long, a long, b long, age long, cost double")

    def best(cost, left, right):
        """Most pairs within the limit, then least cost."""
        found = []
        for n in range(min(len(left), len(right)), 0, -1):
            for some in itertools.combinations(left, n):
                for way in itertools.permutations(right, n):
                    if all((x, y) in cost for x, y in zip(some, way, strict=True)):
                        found.append((sum(cost[x, y] for x, y in zip(some, way, strict=True)), list(zip(some, way, strict=True))))
            if found:
                return min(found)[1]
        return []

    for age in (None, "age"):
        got = detection.assigned_pairs(df, ["g"], "a", "b", "cost", 0.7, age).collect()
        for g in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == g]
            cost = {(r[1], r[2]): r[4] for r in own if r[4] <= 0.7}
            left, right, want = sorted({r[1] for r in own}), sorted({r[2] for r in own}), []
            for level in sorted({r[3] for r in own}) if age else [None]:
                here = [x for x in left if level is None or ages[g, x] == level]
                pairs = best(cost, here, [y for y in right if y not in {p[1] for p in want}])
                want += pairs
            mine = [(r["a"], r["b"]) for r in got if r["g"] == g]
            assert sorted(p for p in mine if None not in p) == sorted(want)
            assert {p[0] for p in mine if p[1] is None} == set(left) - {p[0] for p in want} and {p[1] for p in mine if p[0] is None} == set(right) - {p[1] for p in want}


def test_box_map(spark):
    box = lambda x: [float(x), 0.0, float(x) + 10, 10.0]
    images = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "image_id string, is_labeled boolean")
    truth = spark.createDataFrame([("a", 1, 1, box(0)), ("a", 2, 1, box(50)), ("b", 3, 2, box(0)), ("c", 4, 1, box(0))], "image_id string, gt_id long, category_id int, box array<double>")
    pred = [("a", 1, 1, 0.9, box(0), False), ("a", 2, 1, 0.8, box(20), False), ("a", 3, 1, 0.7, box(50), None), ("a", 4, 1, 0.95, box(80), True), ("b", 5, 2, 0.5, box(3), False), ("d", 6, 1, 0.99, box(0), False), ("c", 7, 1, 0.99, box(0), False)]
    p = spark.createDataFrame(pred, "image_id string, pred_id long, category_id int, score double, box array<double>, ignored boolean")
    got = {(r["category_id"], r["threshold"]): r["ap"] for r in detection.box_map(p, truth, images, [0.5, 0.75]).collect()}
    # class 1: hit, miss, hit: precision 1 up to recall 0.5, then 2/3; class 2: overlap 7/13
    assert got[1, 0.5] == got[1, 0.75] == pytest.approx((51 + 50 * 2 / 3) / 101) and got[2, 0.5] == pytest.approx(1) and got[2, 0.75] == 0


def test_orders(spark):
    df = spark.createDataFrame([("b", "i", 1, 0.5), ("a", "j", None, 0.1), ("a", "j", 2, 0.1), ("a", "i", 9, None)], "video_id string, image_id string, track_id long, score double")
    assert [tuple(r)[:3] for r in ranking.ordered_detections(df).collect()] == [("a", "i", 9), ("a", "j", 2), ("a", "j", None), ("b", "i", 1)]
    got = {(r["video_id"], r["image_id"], r["track_id"]): r["rank"] for r in ranking.by_score(df, ["video_id"], "score", "track_id").collect()}
    assert got[("a", "i", 9)] == 3 and got[("b", "i", 1)] == 1


def test_views_of_boxes_and_points(spark):
    df = spark.createDataFrame([([1.0, 2.0, 10.4, 20.0], [(1.0, 1.0, 0.9), (2.0, 2.0, 0.1)])], "b array<double>, p array<struct<x: double, y: double, c: double>>")
    b, p = F.col("b"), F.col("p")
    row = df.select(
        boxes.seen_as(b, "ltwh", "ltrb").alias("a"), boxes.seen_as(b, "ltwh", "ltwh", F.lit(6.0), F.lit(10.0)).alias("c"), boxes.seen_as(b, "ltwh", "xywh", whole=True).alias("d"),
        F.size(boxes.visible_points(p, 0.5)).alias("n"), boxes.mean_confidence(p).alias("m"),
    ).first()
    assert row["a"] == pytest.approx([1.0, 2.0, 11.4, 22.0]) and row["d"] == [6.0, 12.0, 10.0, 20.0] and row["n"] == 1 and row["m"] == pytest.approx(0.5)
    l, t, w, h = row["c"]
    assert l == 1 and t == 2 and l + w <= 6 and t + h <= 10
    with pytest.raises(ValueError, match="boxes are"):
        boxes.seen_as(b, "ltwh", "polar")


def test_facts_of_reviewed_spans(spark):
    from test_topology import SCHEMA, detections

    df = spark.createDataFrame(detections(), SCHEMA)
    found = topology.lines(df, 25.0)
    spans = spark.createDataFrame([("c", "f1", 0.0, 0.2), ("c", "f2", 5.0, 6.0)], "clip string, fact string, from_s double, to_s double")
    rows = topology.facts(found, topology.zones(found), spans).collect()
    assert {(r["fact"], r["window"]) for r in rows} == {("f1", 0)}
    line = next(x for x in rows[0]["lines"] if x["role"] == "attacking_forward")
    assert sorted(line["member_track_ids"]) == [3, 4] and sorted(line["member_jerseys"]) == [9, 11] and {z["type"] for z in rows[0]["zones"]} == {"unit_band", "inter_line_space"}


def test_parts_are_compared_where_both_see_them(spark):
    a = np.array([[1.0, 0.0, 1, 0, 0, 1]])  # the first of two parts is visible
    b = np.array([[1.0, 1.0, 1, 0, 1, 0], [0.0, 1.0, 1, 0, 0, 1], [1.0, 0.5, 0, 1, 0, 1]])
    assert trackers.part_distances(a, b, 2)[0] == pytest.approx([0.0, 1.0, np.sqrt(2) / 2])
    mixed = trackers._blended_parts(a[0], b[0], 2, 0.9)
    assert mixed[:2].tolist() == [1, 1] and mixed[2:].tolist() == [1, 0, 1, 0]  # the second part is only known from b
    # two people cross; one is half hidden, its visible part tells it
    rows = []
    for f in range(10):
        for k, sign in ((0, 1), (1, -1)):
            x = 100.0 + sign * (50 - 10 * f)
            hidden = k == 0 and 4 <= f <= 7
            look = [1.0, 0.0 if hidden else 1.0, *([1.0, 0.0] if k == 0 else [0.0, 1.0]), *([9.0, 9.0] if hidden else ([1.0, 0.0] if k == 0 else [0.0, 1.0]))]
            rows.append(("v", f, 2 * f + k, [x, 0.0, x + 30, 60.0], 0.9, look))
    df = spark.createDataFrame(rows, "video_id string, frame long, det_id long, box array<double>, score double, features array<double>")
    got = pd.DataFrame([r.asDict() for r in trackers.track_batch(df, "appearance", parts=2, least_iou=0.9).collect()])
    assert got.groupby(got["det_id"] % 2)["track_id"].nunique().tolist() == [1, 1]
