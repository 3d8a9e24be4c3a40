"""Cameras, versioned tables, reports."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import cameras, geometry
from touchline.operators import windows
from touchline.plans import topology
from touchline.sources import reports, versions

rng = np.random.default_rng(8)


def camera():
    pan, tilt, roll = rng.uniform(-0.5, 0.5), rng.uniform(1.0, 1.9), rng.uniform(-0.1, 0.1)
    cp, sp, ct, st, cr, sr = np.cos(pan), np.sin(pan), np.cos(tilt), np.sin(tilt), np.cos(roll), np.sin(roll)
    r = np.array([[cp * cr - sp * sr * ct, sp * cr + cp * sr * ct, sr * st], [-cp * sr - sp * cr * ct, -sp * sr + cp * cr * ct, cr * st], [sp * st, -cp * st, ct]])
    k = np.array([[rng.uniform(800, 3000), 0, 960], [0, rng.uniform(800, 3000), 540], [0, 0, 1.0]])
    at = np.array([rng.uniform(-20, 20), rng.uniform(40, 90), rng.uniform(-25, -8)])
    return k, r, at


def test_ground_points_come_back(spark):
    rows, want = [], []
    for _ in range(40):
        k, r, at = camera()
        world = np.array([rng.uniform(-50, 50), rng.uniform(-30, 30), 0.0])
        rt = np.column_stack([r, -r @ at])
        p = k @ rt @ np.append(world, 1)
        rows.append((k.tolist(), r.tolist(), at.tolist(), rt.tolist(), float(p[0] / p[2]), float(p[1] / p[2])))
        want.append(world[:2])
    df = spark.createDataFrame(rows, "k array<array<double>>, r array<array<double>>, at array<double>, rt array<array<double>>, u double, v double")
    p = cameras.projection(F.col("k"), F.col("rt"))
    c = F.col
    got = df.select(cameras.ground_point(c("k"), c("r"), c("at"), c("u"), c("v")).alias("a"), cameras.ground_point_of(p, c("u"), c("v")).alias("b")).collect()
    for g, w in zip(got, want, strict=True):
        assert [g["a"]["x"], g["a"]["y"]] == pytest.approx(list(w), abs=1e-6) and [g["b"]["x"], g["b"]["y"]] == pytest.approx(list(w), abs=1e-6)
    flat = df.limit(1).select(
        cameras.ground_point(F.expr("array(array(1d,0d,0d),array(0d,1d,0d),array(0d,0d,1d))"), F.expr("array(array(1d,0d,0d),array(0d,0d,1d),array(0d,1d,0d))"), c("at"), F.lit(3.0), F.lit(0.0)).alias("parallel"),
        cameras.ground_point(F.expr("array(array(0d,0d,0d),array(0d,1d,0d),array(0d,0d,1d))"), c("r"), c("at"), F.lit(3.0), F.lit(0.0)).alias("singular"),
        cameras.ground_point(c("k"), c("r"), c("at"), F.lit(float("nan")), F.lit(0.0)).alias("nan"), cameras.ground_point_of(p, F.lit(None).cast("double"), F.lit(0.0)).alias("null"),
    )
    assert flat.first()[:] == (None, None, None, None)
    box = F.array(c("u") - 5, c("v") - 50, c("u") + 5, c("v"))
    got = df.select(cameras.ground_box(lambda u, v: cameras.ground_point(c("k"), c("r"), c("at"), u, v), box).alias("g")).collect()
    assert [(r["g"]["x_bottom_middle"], r["g"]["y_bottom_middle"]) for r in got] == [pytest.approx(tuple(w), abs=1e-6) for w in want]


def test_ground_points_agree_with_homographies(spark):
    k, r, at = camera()
    p = k @ np.column_stack([r, -r @ at])
    h = p[:, [0, 1, 3]]
    df = spark.createDataFrame([(p.tolist(), h.tolist(), float(u), float(v)) for u, v in rng.uniform(100, 900, (10, 2))], "p array<array<double>>, h array<array<double>>, u double, v double")
    got = df.select(cameras.ground_point_of(F.col("p"), F.col("u"), F.col("v")).alias("a"), geometry.project(geometry.inverse(F.col("h")), F.col("u"), F.col("v")).alias("b")).collect()
    assert all(tuple(g["a"]) == pytest.approx(tuple(g["b"])) for g in got)


def dense_line(k, rt, a, b, w, h, n=40001):
    """What of many points along the segment is in front and inside: first and last of them."""
    t = np.linspace(0, 1, n)[:, None]
    p = np.column_stack([a + t * (b - a), np.ones(n)]) @ rt.T
    ok = p[:, 2] > 0.1
    q = p[ok] @ k.T
    s = q[:, :2] / q[:, 2:] / [w, h]
    s = s[((s >= 0) & (s <= 1)).all(axis=1)]
    return s[[0, -1]].ravel() if len(s) else None


def test_lines_are_cut_at_the_camera_and_the_image(spark):
    rows, want = [], []
    for k in range(120):
        K, r, at = camera()
        if k % 4 == 0:
            at = np.array([rng.uniform(-20, 20), rng.uniform(-10, 10), -3.0])  # between the lines' ends
        rt = np.column_stack([r, -r @ at])
        a, b = (np.array([rng.uniform(-50, 50), rng.uniform(-34, 34), 0.0]) for _ in range(2))
        rows.append((K.tolist(), rt.tolist(), tuple(map(float, a)), tuple(map(float, b))))
        want.append(dense_line(K, rt, a, b, 1920, 1080))
    df = spark.createDataFrame(rows, "k array<array<double>>, rt array<array<double>>, a struct<x: double, y: double, z: double>, b struct<x: double, y: double, z: double>")
    got = [r["l"] for r in df.select(cameras.visible_line(F.col("k"), F.col("rt"), F.col("a"), F.col("b"), F.lit(1920.0), F.lit(1080.0)).alias("l")).collect()]
    sure = 0
    for g, w in zip(got, want, strict=True):
        if w is None:
            assert g is None or max(abs(g["x1"] - g["x2"]), abs(g["y1"] - g["y2"])) < 0.02
        else:
            sure += 1
            assert [g[c] for c in ("x1", "y1", "x2", "y2")] == pytest.approx(list(w), abs=0.02)
    assert 20 < sure < 118
    behind = df.limit(1).select(cameras.visible_line(F.expr("array(array(1d,0d,0d),array(0d,1d,0d),array(0d,0d,1d))"), F.expr("array(array(1d,0d,0d,0d),array(0d,1d,0d,0d),array(0d,0d,1d,0d))"), F.expr("named_struct('x',0d,'y',0d,'z',-1d)"), F.expr("named_struct('x',1d,'y',0d,'z',0.05d)"), F.lit(10.0), F.lit(10.0)).alias("l"))
    assert behind.first()["l"] is None


def test_curves_keep_their_points_in_sight(spark):
    eye, rt = "array(array(1d,0d,0d),array(0d,1d,0d),array(0d,0d,1d))", "array(array(1d,0d,0d,0d),array(0d,1d,0d,0d),array(0d,0d,1d,0d))"
    df = spark.createDataFrame([(1, [(1.0, 1.0, 1.0), (2.0, 2.0, 1.0), (3.0, 3.0, -1.0), (5.0, 5.0, 1.0), (50.0, 5.0, 1.0)]), (2, [(1.0, 1.0, 1.0), (-2.0, 2.0, 1.0), (3.0, 3.0, -1.0)])], "id int, p array<struct<x: double, y: double, z: double>>")
    got = {r["id"]: r["s"] for r in df.select("id", cameras.visible_points(F.expr(eye), F.expr(rt), F.col("p"), F.lit(10.0), F.lit(10.0)).alias("s")).collect()}
    assert [v for p in got[1] for v in p] == pytest.approx([0.1, 0.1, 0.2, 0.2, 0.5, 0.5]) and got[2] is None


# Versions


def set_of(spark, n):
    return {"train": spark.range(n).withColumn("v", F.lit(n)), "valid": spark.range(n + 5).withColumn("v", F.lit(n))}


def whole(v):
    """The version of all tables that a reader sees."""
    seen = {v.read(t).select(F.max("v")).first()[0] for t in ("train", "valid")}
    assert len(seen) == 1
    return seen.pop()


def test_a_failure_after_any_step_leaves_a_whole_version(spark, tmp_path):
    steps = []
    v = versions.Versions(spark, f"file://{tmp_path}/t", steps.append)
    assert v.current() is None and v.promote("v1", set_of(spark, 10), expected={"train": 10, "valid": 15}) is None
    assert whole(v) == 10 and steps == ["written train", "checked train", "written valid", "checked valid", "renamed"]
    for k, at in enumerate(steps):
        def stop(step, at=at):
            if step == at:
                raise RuntimeError(at)

        broken = versions.Versions(spark, f"file://{tmp_path}/t", stop)
        with pytest.raises(RuntimeError, match=at):
            broken.promote(f"x{k}", set_of(spark, 20 + k))
        now = at == "renamed"
        assert whole(v) == (20 + k if now else 10) and v.current() == (f"x{k}" if now else "v1")
        assert (tmp_path / "t" / f"x{k}").exists() == now
    assert v.roll_back() == "v1" and whole(v) == 10
    with pytest.raises(KeyError):
        v.roll_back()
    with pytest.raises(FileExistsError):
        v.promote("v1", set_of(spark, 3))


def test_faults_are_told_and_a_cut_promotion_goes_on(spark, tmp_path):
    v = versions.Versions(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError, match="valid: 8 rows, 9 expected"):
        v.promote("a", set_of(spark, 3), expected={"train": 3, "valid": 9}, keep=True)
    assert v.done("a") == ["train"] and v.current() is None and not (tmp_path / "t/a/valid").exists()
    wrong = {"train": spark.range(1).withColumn("v", F.lit(99)), "valid": set_of(spark, 3)["valid"]}
    v.promote("a", wrong, checks={"valid": lambda df: [] if df.count() == 8 else ["few"]})
    assert whole(v) == 3  # train was done before and is not written again
    with pytest.raises(ValueError, match="train: bad"):
        v.promote("b", set_of(spark, 4), checks={"train": lambda df: ["bad"]})
    with pytest.raises(ValueError, match="missing: test"):
        v.promote("c", set_of(spark, 4), expected={"test": 1})
    assert v.current() == "a" and not (tmp_path / "t/b").exists() and not (tmp_path / "t/c").exists()


# Reports


def test_reports_become_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b|c", None), (1, "a", 1.5), (3, 'x "q"\ny', 0.0)], "k int, name string, v double")
    text = reports.markdown(rows, ["k", "name", "v"], ["k"]).first()["text"]
    assert text == '| k | name | v |\n|---|---|---|\n| 1 | a | 1.5 |\n| 2 | b\\|c | - |\n| 3 | x "q" y | 0.0 |'
    assert reports.markdown(rows.where("k > 9"), ["k"], ["k"]).count() == 0
    reports.write_text(reports.markdown(rows, ["k"], ["k"]), str(tmp_path / "t"))
    reports.write_json(rows, str(tmp_path / "j"))
    reports.write_csv(rows, str(tmp_path / "c"), ["k"])
    one = lambda d: next(p for p in Path(tmp_path / d).iterdir() if p.name.startswith("part-")).read_text()
    assert one("t").startswith("| k |\n|---|\n| 1 |") and sorted(json.loads(x)["k"] for x in one("j").splitlines()) == [1, 2, 3] and '"v":null' in one("j")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert [r["name"] for r in back.collect()] == ["a", "b|c", 'x "q"\ny']
    with pytest.raises(ValueError, match="at most 2"):
        reports._bounded(rows, 2)


def test_calibration_report(spark):
    rows = [("g", f, not 5 <= f < 12, 1.0 if 5 <= f < 12 else 20.0) for f in range(20)] + [("h", f, True, 9.0) for f in range(3)]
    df = spark.createDataFrame(rows, "g string, f long, ok boolean, kp double")
    runs = windows.calibration_dropouts(df, "g", "f", F.col("ok"), "kp")
    got = {r["g"]: r for r in reports.calibration_report(df, runs, "g", F.col("ok")).collect()}
    assert got["g"]["status"] == "dropout" and [tuple(d)[:3] for d in got["g"]["dropouts"]] == [(5, 11, 7)] and got["g"]["n_valid"] == 13
    assert got["h"]["status"] == "ok" and got["h"]["dropouts"] == [] and got["h"]["valid_share"] == 1.0


def test_image_list(spark):
    images = spark.createDataFrame([(1, 7, 0, "/x/y/000001.jpg", True), (2, 8, 0, "a.jpg", None), (3, 9, 0, "b.jpg", True)], "id long, video_id long, frame long, file_path string, is_labeled boolean")
    videos = spark.createDataFrame([(7, "v7"), (8, "v8")], "id long, name string")
    assert sorted(map(tuple, reports.image_list(images, videos).collect())) == [("v7/000001.jpg", 1, 1, 7, True), ("v8/a.jpg", 2, 2, 8, False)]


def test_digest_as_text(spark):
    from test_topology import SCHEMA, detections

    df = spark.createDataFrame(detections(), SCHEMA)
    found = topology.lines(df, 25.0)
    rows = reports.digest_rows(found, topology.zones(found), topology.ball_summary(df, 25.0))
    clips = spark.createDataFrame([("c", "tracking"), ("empty", None)], "clip string, position_source string")
    got = {r["clip"]: r["text"].split("\n") for r in reports.digest_text(rows, clips).collect()}
    assert got["c"][0] == "position_source=tracking"
    assert got["c"][1] == "t=0.0s attack=left forward[left]=x10.0m/span20.0m midfield[left]=x-5.0m/span20.0m last_line[right]=x20.0m/span20.0m gap=15.0m ball=x-5.0m/y-10.0m/move0.0m"
    assert got["empty"] == ["position_source=", "no renderable topology windows (insufficient ball/goalkeeper/possession evidence)"]
