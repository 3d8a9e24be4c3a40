from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.streaming import flows, lifecycle, moving, trackers

SCHEMA = "video_id string, frame long, det_id long, box array<double>, score double"


def frames():
    out = []
    for f in range(12):
        out.append(("v", f, 10 * f, [float(2 * f), 0.0, float(2 * f) + 20, 20.0], 0.9))
        if f not in (4, 5):
            out.append(("v", f, 10 * f + 1, [200.0 - 2 * f, 50.0, 220.0 - 2 * f, 80.0], 0.9 if f % 3 else 0.65))
        out.append(("w", f, 10 * f + 2, [0.0, 0.0, 10.0, 10.0], 0.9))
    return out


def by_track(rows):
    got = {}
    for r in rows:
        got.setdefault((r["video_id"], r["track_id"]), []).append(r["det_id"] % 10)
    return got


def test_trackers_keep_identities(spark):
    df = spark.createDataFrame(frames(), SCHEMA)
    for name in ("propagation", "two_stage"):
        got = by_track(trackers.track_batch(df, name).orderBy("frame").collect())
        assert len(got) == 3 and all(len(set(v)) == 1 for v in got.values()), (name, got)


def test_trackers_by_motion_appearance_and_pitch(spark):
    df = spark.createDataFrame([(*r, [1.0, 0.0] if r[2] % 10 == 1 else [0.0, 1.0]) for r in frames()], SCHEMA + ", features array<double>")
    for name, options in (("observation_centric", {}), ("appearance", {}), ("pitch", {"most_metres": 30.0})):
        got = by_track(trackers.track_batch(df, name, **options).orderBy("frame").collect())
        assert len(got) == 3 and all(len(set(v)) == 1 for v in got.values()), (name, got)
    # two objects swap places while unseen: appearance finds them again, overlap does not
    a, b = [0.0, 0.0, 10.0, 20.0], [100.0, 0.0, 110.0, 20.0]
    rows = [("v", f, 2 * f + k, box, 0.9, feature) for f in (0, 1, 2, 12, 13) for k, (box, feature) in enumerate(((a if f < 9 else b, [1.0, 0.0]), (b if f < 9 else a, [0.0, 1.0])))]
    both = spark.createDataFrame(rows, SCHEMA + ", features array<double>")
    got = trackers.track_batch(both, "appearance").collect()
    assert len({r["track_id"] for r in got if r["det_id"] % 2 == 0}) == 1 and len({r["track_id"] for r in got}) == 2


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    df = spark.createDataFrame(frames(), SCHEMA)
    for k in range(3):
        df.where((F.col("frame") >= 4 * k) & (F.col("frame") < 4 * k + 4)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = trackers.track_stream(stream, "two_stage").writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = sorted(map(tuple, trackers.track_batch(df, "two_stage").collect()))
    assert sorted(map(tuple, spark.table("tracked").collect())) == want


def test_carried_values_and_replayed_batches(spark, tmp_path):
    df = spark.createDataFrame([("v", 0, 1.5), ("v", 1, None), ("v", 2, None), ("w", 0, None)], "k string, f long, h double")
    df.where("f < 2").coalesce(1).write.parquet(str(tmp_path / "in/0"))
    df.where("f >= 2").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = flows.to_table(flows.carried_stream(stream, "k", "f", "h"), str(tmp_path / "out"), str(tmp_path / "c")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["k"], r["f"], r["h"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("v", 0, 1.5), ("v", 1, 1.5), ("v", 2, 1.5), ("w", 0, None)]


def test_windows_of_frames(spark):
    df = spark.range(10).select(flows.event_time(F.col("id"), 10.0).alias("at"), F.lit("a").alias("k"), F.lit(1.0).alias("v"))
    got = flows.windowed_counts(df, "at", ["k"], "v").orderBy("start").collect()
    assert [r["n"] for r in got] == [5, 10, 5]


# A moving camera


def panned(pan=60.0, still=False):
    """Three walkers under a camera that pans by ``pan`` a frame, after a zoom at frame 6; (detections, motion)."""
    rows, motion, at = [], [], np.array([[1.0, 0, 0], [0, 1, 0]])
    for f in range(14):
        warp = np.array([[1.0, 0, -pan], [0, 1, 0]]) if f != 6 else np.array([[1.2, 0, -pan], [0, 1.2, 5]])
        if f and not still:
            at = warp @ np.vstack([at, [0, 0, 1]])
        motion.append(("v", f, (warp if f and not still else np.array([[1.0, 0, 0], [0, 1, 0]])).ravel().tolist()))
        for k in range(3):
            if f == 9 or (k == 1 and f in (4, 5)):
                continue  # a frame without detections, an object out of sight
            corners = np.array([[200.0 * k + 3 * f, 40], [200.0 * k + 3 * f + 30, 120]]) @ at[:, :2].T + at[:, 2]
            rows.append(("v", f, 10 * f + k, corners.ravel().tolist(), 0.9 if k < 2 or f % 4 else 0.55, [float(k == 0), float(k == 1), float(k == 2), 0.1]))
    return rows, motion


MOVING = ["propagation", "two_stage", "observation_centric", "appearance", "camera", "deep_observation_centric"]


@pytest.mark.parametrize("name", MOVING)
def test_motion_keeps_identities(spark, name):
    rows, motion = panned()
    schema = SCHEMA + ", features array<double>"
    plain = name in ("propagation", "two_stage", "observation_centric")
    df = spark.createDataFrame([r[:5] for r in rows] if plain else rows, SCHEMA if plain else schema)
    both = moving.with_motion(df, spark.createDataFrame(motion, "video_id string, frame long, warp array<double>"))
    options = {"decay": 0.9, "least_iou": 0.3} if name == "propagation" else {}
    got = by_track(trackers.track_batch(both.repartition(4), name, **options).collect())
    assert len(got) == 3 and all(len(set(v)) == 1 for v in got.values()), (name, got)
    if plain:
        assert len(by_track(trackers.track_batch(df, name, **options).collect())) > 3


@pytest.mark.parametrize("name", MOVING)
def test_no_motion_changes_nothing(spark, name):
    rows, motion = panned(still=True)
    df = spark.createDataFrame(rows, SCHEMA + ", features array<double>")
    both = moving.with_motion(df, spark.createDataFrame(motion, "video_id string, frame long, warp array<double>").where("frame <> 9"))
    want = sorted(map(tuple, trackers.track_batch(df, name).collect()))
    assert want and sorted(map(tuple, trackers.track_batch(both, name).collect())) == want


def test_camera_tracker_without_motion_or_features_follows_as_two_stages_do(spark):
    df = spark.createDataFrame(frames(), SCHEMA)
    assert by_track(trackers.track_batch(df, "camera").orderBy("frame").collect()) == by_track(trackers.track_batch(df, "two_stage").orderBy("frame").collect())


@pytest.mark.parametrize("name", ["camera", "deep_observation_centric"])
def test_motion_in_a_stream_gives_what_the_batch_gives(spark, tmp_path, name):
    rows, motion = panned()
    both = moving.with_motion(spark.createDataFrame(rows, SCHEMA + ", features array<double>"), spark.createDataFrame(motion, "video_id string, frame long, warp array<double>")).cache()
    for k in range(4):
        both.where((F.col("frame") >= 4 * k) & (F.col("frame") < 4 * k + 4)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = trackers.track_stream(stream, name).writeStream.format("memory").queryName(f"moved_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table(f"moved_{name}").collect())) == sorted(map(tuple, trackers.track_batch(both, name).collect()))


def test_appearance_counts_less_where_it_tells_nothing_apart():
    c = np.array([[0.9, 0.1], [0.8, 0.8]])
    # rows: second over best 1/9 and 1; columns: 8/9 and 1/8; only what exceeds a half weighs down
    column = [1 - (8 / 9 - 0.5) / 0.5, 1.0]
    want = np.array([[0.9 * column[0], 0.1], [0.0, 0.0]])
    assert np.allclose(moving._weighed(c, 1.0, 0.5), want)


# The life of a video's state


def spoken(start, frames, video="v"):
    return [(video, f, 10 * f + k, [100.0 * k + f, 0.0, 100.0 * k + f + 30, 60.0], 0.9, start + f) for f in frames for k in range(2)]


def life_of(spark, tmp_path, batches, name, idle_ms=20_000, parts=None):
    """Run batches of (video, frame, det, box, score, second) as a stream; ``parts`` cuts the run into several queries on one checkpoint."""
    schema = SCHEMA + ", second long"
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("second")).drop("second")
        df.coalesce(1).write.parquet(str(tmp_path / f"all/{k}"))
    (tmp_path / "in").mkdir()
    queries, kind = [], spark.read.parquet(str(tmp_path / "all/0")).schema
    for upto in parts or [len(batches)]:
        for k in range(upto):
            if not (tmp_path / f"in/{k}").exists():
                (tmp_path / f"all/{k}").rename(tmp_path / f"in/{k}")
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        tracked = lifecycle.tracked_videos(stream, "at", idle_ms=idle_ms)
        q = flows.to_table(tracked, str(tmp_path / "out"), str(tmp_path / "c")).outputMode("append").start()
        try:
            q.processAllAvailable()
            queries.append((lifecycle.late_rows(q), lifecycle.held_rows(q)))
        finally:
            q.stop()
    rows = spark.read.option("recursiveFileLookup", "true").schema(lifecycle.OUTPUT).parquet(str(tmp_path / "out")).collect()
    return rows, queries


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k) for k in lifecycle.SETTINGS}
    for k, v in lifecycle.SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_silent_video_is_closed_and_its_state_leaves(spark, tmp_path, rocks):
    # v stops after 12 seconds; w goes on, out of order by two seconds; late rows of v come when it is closed
    w = [r[:5] + (r[5],) for r in spoken(1000, range(70), "w")]
    shuffled = lambda a, b: [r for f in range(a, b, 2) for g in (f + 1, f) for r in w if r[1] == g]
    batches = [spoken(1000, range(6)) + shuffled(0, 6), spoken(1000, range(6, 12)) + shuffled(6, 12), shuffled(12, 30), shuffled(30, 50) + spoken(1000, [3]), shuffled(50, 70)]
    batches.append([("x", 0, 0, [0.0, 0.0, 9.0, 9.0], 0.9, 2000)])
    batches.append([("x", 1, 1, [0.0, 0.0, 9.0, 9.0], 0.9, 3000)])
    batches.append([("y", 0, 0, [0.0, 0.0, 9.0, 9.0], 0.9, 4000)])
    rows, ((late, held),) = life_of(spark, tmp_path, batches, "one")
    closed = {r["video_id"]: (r["frame"], r["n_frames"], r["n_detections"], r["n_tracks"]) for r in rows if r["kind"] == "closed"}
    assert closed["v"] == (11, 12, 24, 2) and closed["w"] == (69, 70, 140, 2)
    assert late == 2  # the two rows of frame 3 that came again
    assert held < 10  # of x and y only: nothing of v and w
    tracks = [r for r in rows if r["kind"] == "track"]
    want = trackers.track_batch(spark.createDataFrame([r[:5] for r in spoken(1000, range(12)) + w], SCHEMA), "two_stage").collect()
    got = sorted((r["video_id"], r["frame"], r["det_id"], r["track_id"]) for r in tracks if r["video_id"] in "vw")
    assert got == sorted(map(tuple, want))


def test_a_restart_repeats_nothing_and_a_closed_video_may_speak_again(spark, tmp_path, rocks):
    batches = [spoken(1000, range(8)), spoken(1000, range(8, 16)), spoken(1100, range(8)), spoken(1300, range(1), "w"), spoken(1500, range(1), "w")]
    rows, runs = life_of(spark, tmp_path, batches, "two", parts=[1, 2, 5])
    v = [r for r in rows if r["video_id"] == "v" and r["kind"] == "closed"]
    assert sorted(r["n_frames"] for r in v) == [8, 16] and all(r["n_tracks"] == 2 for r in v)
    seen = [(r["frame"], r["det_id"]) for r in rows if r["video_id"] == "v" and r["kind"] == "track"]
    assert len(seen) == 2 * (16 + 8) and sum(late for late, _ in runs) == 0
