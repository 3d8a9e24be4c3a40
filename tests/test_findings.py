"""Results that parted from their SQL, and folds over many small groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from touchline import queries
from touchline.evaluation import assignment, detection, regions, track_precision, tracking
from touchline.functions import cameras, masks, rounding
from touchline.operators import claims, frames, preparation, ranking, segments, windows
from touchline.plans import stage, topology
from touchline.sources import readers, reports
from touchline.streaming import moving


def test_csv_beyond_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "REPORT_ROWS", 3)
    rows = spark.range(10, numPartitions=2).select((9 - F.col("id")).alias("k"), F.concat(F.lit('a "b"\nc'), F.col("id").cast("string")).alias("note"))
    reports.write_csv(rows, str(tmp_path / "c"), ["k"])
    parts = sorted(p for p in (tmp_path / "c").iterdir() if p.name.startswith("part-"))
    assert len(parts) >= 4 and all(p.read_text().startswith("k,note\n") for p in parts)
    assert [int(line.split(",")[0]) for p in parts for line in p.read_text().splitlines()[1:] if "," in line] == list(range(10))
    back = readers.all_string_csv(spark, str(tmp_path / "c"), ["k", "note"])
    assert sorted((int(r["k"]), r["note"]) for r in back.collect()) == [(k, f'a "b"\nc{9 - k}') for k in range(10)]


def test_half_even_of_computed_values(spark):
    beside = math.nextafter(0.4434365, 1)
    values = [0.4434365, beside, -2.5, 40.5, None, float("nan")]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r for r in rows.select(rounding.half_even(F.col("v"), 6).alias("a"), rounding.half_even(F.col("v")).alias("b")).collect()]
    assert [r["a"] for r in got[:4]] == [round(v * 1e6) / 1e6 for v in values[:4]] and [r["b"] for r in got[2:4]] == [-2.0, 40.0]
    assert got[4]["a"] is None and math.isnan(got[5]["a"])
    mean = spark.range(1).select(F.lit(40.50000000000001).alias("m"))
    assert mean.select(rounding.half_even(F.col("m")), rounding.half_even(F.col("m"), slack=4)).first()[:] == (41.0, 40.0)


def test_image_points_round_like_the_division(spark):
    k = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in ((1000, 0, 960), (0, 1000, 540), (0, 0, 1))))
    rows = spark.range(2000).select((F.col("id") * 0.37 - 300).alias("x"), (F.col("id") % 13 * 8.0 + 3).alias("d"))
    seen = cameras._seen(k, F.struct("x", F.lit(8.0).alias("y"), F.col("d").alias("z")), F.lit(1920.0), F.lit(1080.0))
    for r in rows.select("x", "d", seen.alias("s")).collect():
        assert (r["s"]["x"], r["s"]["y"]) == ((1000 * r["x"] / r["d"] + 960) / 1920, (8000 / r["d"] + 540) / 1080)


def test_ball_by_a_given_order(spark):
    rows = spark.createDataFrame([("c", 0, "ball", 1.0, 0.0, 5_000), ("c", 1, "ball", 4.0, 4.0, 10), ("c", 2, "ball", 7.0, 0.0, 20)], "clip string, frame long, role string, x double, y double, pos long")
    moved = lambda order: {r["window"]: r["displacement_m"] for r in topology.ball_summary(rows, 25.0, order=order).collect()}[0]
    assert moved(None) == 6.0 and moved(F.col("frame") * 1000 + F.col("pos")) == 5.0


def test_alignment_counts_the_least_similarity(spark):
    sim = spark.createDataFrame([("s", 0, 1, 2, 1e-16)], "seq string, t long, gt_id long, tracker_id long, sim double")
    at = [sim.select("seq", "t", c) for c in ("gt_id", "tracker_id")]
    assert tracking.alignment(sim, *at, least=0.0).first()["potential"] == 1.0 and tracking.alignment(sim, *at).first()["potential"] == 0.0


def test_mean_of_votes_is_a_tie_in_any_order(spark):
    values = [2.08, 53.21, 44.35, 0.75, 76.93, 72.19, 31.22, 56.23, 27.54]  # a mean of 40.5, by additions in this order 40.50000000000001
    rows = spark.createDataFrame([("a", "yes", v, k) for k, v in enumerate(values)], "clip string, verdict string, c double, pos long").coalesce(1)
    assert claims.sample_vote(rows, ["clip"], "verdict", "c", "pos").first()["c"] == 40.0


def test_votes_in_order_are_added_as_the_sql_adds_them(spark, tmp_path):
    import duckdb

    values = [2.08, 53.21, 44.35, 0.75, 76.93, 72.19, 31.22, 56.23, 27.54]  # in this order 40.50000000000001, from behind 40.5
    rows = [(u * 100 + k, u, "view", v) for u, some in ((1, values), (2, values[::-1])) for k, v in enumerate(some)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").orderBy("event_id").coalesce(1)
    events.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(map(tuple, queries.sample_vote(spark, str(tmp_path)).collect()))
    assert got == [(1, "view", 41.0), (2, "view", 40.0)] == sorted(con.execute(queries.oracle_sql()["sample_vote"]).fetchall())


def test_whole_groups_over_batches():
    rows = pd.DataFrame({"k": [1, 1, 2, 3, 3, 3, 3, None, None, 5], "v": range(10)})
    for size in range(1, 11):
        seen = []
        for some, firsts in frames.whole_groups((rows.iloc[i : i + size] for i in range(0, 10, size)), ["k"]):
            seen += [some["v"].tolist()[a:b] for a, b in zip(firsts, [*firsts[1:], len(some)], strict=True)]
        assert seen == [[0, 1], [2], [3, 4, 5, 6], [7, 8], [9]]


def test_small_groups_share_a_call(spark):
    calls = spark.sparkContext.accumulator(0)

    def placed(rows):
        calls.add(1)
        return rows.assign(place=rows.groupby("image_id").cumcount() + 1)

    rows = spark.range(4000).select(F.col("id").alias("det_id"), F.lit(0).alias("video_id"), F.expr("id div 2").alias("image_id"))
    one = stage.images_stage("place", placed, [], {"place": "bigint"}, many=True)
    out = stage.run_stages([one], {"detections": rows})["detections"].collect()
    assert sorted(r["place"] for r in out) == [1] * 2000 + [2] * 2000 and calls.value < 100


def test_hours_of_other_sequences_are_other_frames(spark, tmp_path):
    rows = [(0, 1, "click", 10.0), (1, 1, "error", 10.0), (2, 61, "click", 10.0), (3, 61, "error", 100.0)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.lit(3600 * 48)))
    events.write.parquet(str(tmp_path / "events.parquet"))
    out = queries.box_average_precision(spark, str(tmp_path)).collect()
    assert len(out) == 12 and all(abs(r["ap"] - 51 / 101) < 1e-9 for r in out)  # one of two truths is found


def test_many_masks_at_once_are_as_one_by_one():
    rng = np.random.default_rng(3)
    a, b, h, w = [], [], rng.integers(1, 40, 300), rng.integers(1, 40, 300)
    for m, n in zip(h.tolist(), w.tolist(), strict=True):
        for side in (a, b):
            side.append(None if rng.random() < 0.1 else "" if rng.random() < 0.1 else masks.encode(rng.random((m, n)) < rng.random()))
    got = masks._boundary_scores(a, b, h, w)
    assert got.tolist() == [masks.boundary_f(x, y, m, n) for x, y, m, n in zip(a, b, h.tolist(), w.tolist(), strict=True)]
    overlaps = masks._overlaps(a, b, h, w)
    for x, y, m, n, j in zip(a, b, h.tolist(), w.tolist(), overlaps, strict=True):
        if x is None or y is None:
            assert np.isnan(j)
        elif x and y:
            p, q = masks.decode(x, m, n), masks.decode(y, m, n)
            assert j == ((p & q).sum() / (p | q).sum() if (p | q).any() else 0.0)


def test_small_slices_of_masks_give_the_same(monkeypatch):
    a, b, size = pd.Series(["1 3 4", "0 4 4", None] * 20), pd.Series(["2 3 3", None, "0 8"] * 20), pd.Series([2, 4, 8] * 20)
    wide = 8 // size
    whole = masks.boundary_score.func(a, b, size, wide).tolist()
    monkeypatch.setattr(masks, "WORK", 5)
    assert masks.boundary_score.func(a, b, size, wide).tolist() == whole


def test_runs_of_many_masks_keep_their_keys(spark):
    rows = spark.createDataFrame([(1, None, "2 3 0 4"), (2, "x", None), (None, "y", "0 5 2"), (4, "z", "9")], "k long, s string, m string")
    got = {tuple(r) for r in segments.run_rows(rows, ["k", "s"], "m", "a", "b").collect()}
    assert got == {(1, None, 2, 5), (1, None, 5, 9), (None, "y", 0, 5)}
    seen = segments.run_rows(rows, ["k"], "m", "a", "b")._jdf.queryExecution().toString()
    assert "MapInArrow" in seen and "aggregate(" not in seen


def test_tracks_are_judged_many_at_once(spark):
    calls = spark.sparkContext.accumulator(0)
    real = frames.by_group

    def counted(rows, keys, fn, schema):
        return real(rows, keys, lambda pdf, firsts: (calls.add(1), fn(pdf, firsts))[1], schema)

    spark.conf.set("spark.sql.shuffle.partitions", "4")
    seqs = spark.range(3000)
    truth = seqs.select(F.col("id").alias("seq"), F.lit(1).cast("long").alias("gt_id"), F.lit(500.0).alias("area"), F.lit(2).cast("long").alias("frames"))
    two = seqs.select(F.col("id").alias("seq"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("tracker_id"))
    predicted = two.select("seq", "tracker_id", (F.col("tracker_id") / 10).alias("score"), F.lit(500.0).alias("area"), F.lit(2).cast("long").alias("frames"))
    overlaps = two.select("seq", F.lit(1).cast("long").alias("gt_id"), "tracker_id", F.lit(0.8).alias("iou"))
    track_precision.in_frames.by_group = counted
    try:
        out = {(r["range"], r["threshold"]): r for r in track_precision.track_precision(overlaps, truth, predicted).collect()}
    finally:
        track_precision.in_frames.by_group = real
    assert 0 < calls.value < 50
    assert out["all", 0.5]["ap"] > 1 - 1e-9 and out["all", 0.5]["ar"] == 1.0 and out["all", 0.5]["n_predicted"] == 6000
    assert out["all", 0.9]["ap"] == 0.0 and out["area_l", 0.5]["ap"] is None
    assert track_precision.track_precision(overlaps, truth.where("false"), predicted).count() == 0


def test_boxes_are_matched_many_frames_in_a_call_and_once(spark):
    rng = np.random.default_rng(11)
    frames_, n_pred, n_truth, levels = 3000, 4, 3, [0.01, 0.5, 0.75]
    iou = np.round(rng.integers(-4, 5, (frames_, n_pred, n_truth)) / 4, 2)  # equal ones, and pairs that are not listed
    pairs = spark.createDataFrame([(f, p, g, float(iou[f, p, g])) for f, p, g in zip(*map(np.ndarray.tolist, np.nonzero(iou > 0)), strict=True)], "frame long, pred_id long, gt_id long, iou double")
    pred = spark.createDataFrame([(f, p, -p) for f in range(frames_) for p in range(n_pred)], "frame long, pred_id long, pos long")
    want = {}
    for f in range(frames_):
        for level in levels:
            taken = dict(zip(*map(np.ndarray.tolist, assignment.greedy(iou[f, ::-1], level)), strict=True))
            want |= {(f, level, p): taken.get(n_pred - 1 - p) for p in range(n_pred)}
    matches = detection.greedy_matches(pairs, pred, levels)
    assert {tuple(r)[:3]: r["gt_id"] for r in matches.collect()} == want
    scored = pred.withColumn("score", (F.col("pred_id") % 2).cast("double"))
    plain = {r["threshold"]: r["ap"] for r in detection.average_precision(matches, scored.select("frame", "pred_id", "score"), frames_ * n_truth).collect()}
    calls, real = spark.sparkContext.accumulator(0), frames.by_group

    def counted(rows, keys, fn, schema):
        def call(*args):
            calls.add(1)
            return fn(*args)

        return real(rows, keys, call, schema)

    detection.in_frames.by_group = counted
    try:
        got = {r["threshold"]: r["ap"] for r in detection.box_precision(pairs, pred.join(scored.drop("pos"), ["frame", "pred_id"]), frames_ * n_truth, levels).collect()}
    finally:
        detection.in_frames.by_group = real
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 1e-12 for k in got) and 0 < calls.value < 50


def test_pairs_of_masks_leave_their_sequence_as_sums(spark, monkeypatch):
    monkeypatch.setattr(regions, "PAIRS", 7)
    monkeypatch.setattr(masks, "WORK", 50)
    rng, shape, want = np.random.default_rng(5), (6, 5), {}
    sides = [{(s, i, t): rng.random(shape) < 0.2 * i for s in "ab" for i in range(3) for t in range(20) if rng.random() < 0.8} for _ in range(2)]  # track 0 has no pixels
    for (s, g, t), x in sides[0].items():
        want[s, g, None] = want.get((s, g, None), 0) + bool(x.any())
        for (u, k, v), y in sides[1].items():
            if (s, t) == (u, v) and x.any() and y.any():
                want[s, g, k] = want.get((s, g, k), 0) + 1 + (x & y).sum() / (x | y).sum()
    for (s, k, _), y in sides[1].items():
        want[s, None, k] = want.get((s, None, k), 0) + bool(y.any())
    truth, predicted = (spark.createDataFrame([(*k, masks.encode(m) if m.any() or k[2] % 2 else None) for k, m in side.items()], "seq string, id long, t long, mask string") for side in sides)
    rows, got = regions.overlap_sums(truth, predicted).collect(), {}
    for r in rows:
        got[r["seq"], r["gt_id"], r["tracker_id"]] = got.get((r["seq"], r["gt_id"], r["tracker_id"]), 0) + r["v"]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(rows) < 100  # 288 pairs of masks or so
    images = spark.createDataFrame([(s, 20, *shape) for s in "ab"], "seq string, n_frames long, h int, w int")
    scores = regions.region_scores(truth, predicted, images)
    assert "__bin" not in scores._jdf.queryExecution().optimizedPlan().toString() and scores.count() == 2
    alone = regions.region_scores(truth, predicted.where("false"), images).orderBy("seq").collect()
    assert [r["n_tracks"] for r in alone] == [3, 3] and alone[0]["j_mean"] < 1


def test_tracks_of_boxes_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(track_precision, "PAIRS", 20)
    rng = np.random.default_rng(21)

    def side(n):
        tracks = [(s, i, rng.integers(0, 60, 2), rng.integers(4, 40, 2)) for s in ("a", "b", "c") for i in range(n)]
        rows = [(s, i, t, [float(x[0] + t), float(x[1]), float(x[0] + t + w[0] - (i == 2) * 50), float(x[1] + w[1])]) for s, i, x, w in tracks for t in range(9) if rng.random() < 0.8]  # some boxes have no width
        return spark.createDataFrame(rows, "seq string, id long, t long, box array<double>")

    truth, predicted = side(7).withColumn("crowd", F.when(F.col("id") != 4, F.col("id") == 3)), side(9)
    moved = truth.select("seq", (F.col("id") + 20).alias("id"), "t", F.transform("box", lambda v, k: v + F.when(k % 2 == 0, 1.0).otherwise(0.0)).alias("box"))
    predicted = predicted.unionByName(moved).withColumn("score", F.when(F.col("id") % 7 > 0, F.col("id") % 3 / 4)).withColumn("open", F.col("seq") == "b")
    ranges, levels = [("all", None, 0.0, 0.0), ("small", "area", 0.0, 400.0), ("long", "frames", 8.0, 1e5), ("none", "area", 1e8, 1e9)], [0.1, 0.5, 0.9]
    measured = lambda df, name, *more: track_precision.measured(df, ["seq", "id", *more]).withColumnRenamed("id", name)
    for p, g in ((predicted, truth), (predicted.where("false"), truth), (predicted, truth.where("false"))):
        overlaps = tracking.track_overlap(g, p, touching=True).withColumnsRenamed({"a_id": "gt_id", "b_id": "tracker_id"})
        want = track_precision.track_precision(overlaps, measured(g, "gt_id", "crowd"), measured(p, "tracker_id", "score", "open"), ranges, levels)
        got = track_precision.box_track_precision(g, p, ranges, levels)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() == (0 if g is not truth else 12)
    marks = track_precision.box_marks(truth, predicted, ranges, levels)
    assert marks._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1 and "Join" not in marks._jdf.queryExecution().optimizedPlan().toString()


def test_envelope_reads_each_row_once(spark):
    curve = spark.range(1, 41).select((F.col("id") / 40).alias("recall"), (1 / F.col("id")).alias("precision"))
    area = ranking.stepwise_ap(curve)
    assert abs(area.first()["ap"] - sum(1 / k for k in range(1, 41)) / 40) < 1e-12
    plan = area._jdf.queryExecution().optimizedPlan().toString()
    assert "max(p" in plan and not [line for line in plan.splitlines() if "max(p#" in line and "currentrow$(), unboundedfollowing$()" in line]


def test_frames_are_matched_many_in_a_call(spark):
    rng = np.random.default_rng(8)
    pairs = [(s, t, g, k, float(rng.integers(1, 5)) / 4) for s in ("a", "b") for t in range(40) for g in range(rng.integers(1, 4)) for k in range(rng.integers(1, 4)) if rng.random() < 0.8]
    sim = spark.createDataFrame(pairs, "seq string, t long, gt_id long, tracker_id long, sim double")
    rows = tracking.frame_matches(sim, "sim")
    got = {tuple(r) for r in rows.collect()}
    want = set()
    for frame in {p[:2] for p in pairs}:
        one = {p[2:4]: p[4] for p in pairs if p[:2] == frame}
        g, k = sorted({p[0] for p in one}), sorted({p[1] for p in one})
        for i, j in zip(*assignment.assign(-np.array([[one.get((a, b), 0.0) for b in k] for a in g])), strict=True):
            if (g[i], k[j]) in one:
                want.add((*frame, g[i], k[j], one[g[i], k[j]]))
    assert got == want and "MapInPandas" in rows._jdf.queryExecution().toString()


def test_many_tracks_move_at_once():
    rng = np.random.default_rng(3)
    z, warp = rng.uniform(1, 50, (40, 4)), np.array([[0.9, -0.2, 3.0], [0.1, 1.1, -2.0]])
    mean, cov = moving.Extent.warped(*moving.Extent.predict(*moving.Extent.start(z)), warp)
    again = moving.Extent.update(mean, cov, z + 1)
    f, big = np.eye(8) + np.eye(8, k=4), np.kron(np.eye(4), warp[:, :2])
    for k, (x, y, w, h) in enumerate(z):
        c = np.diag(np.square([w / 10, h / 10] * 2 + [w / 16, h / 16] * 2))
        c = big @ (f @ c @ f.T + np.diag(np.square([w / 20, h / 20] * 2 + [w / 160, h / 160] * 2))) @ big.T
        m = big @ np.array([x, y, w, h, 0, 0, 0, 0]) + np.array([3.0, -2.0, 0, 0, 0, 0, 0, 0])
        s = c[:4, :4] + np.diag(np.square([m[2] / 20, m[3] / 20] * 2))
        gain = c[:, :4] @ np.linalg.inv(s)
        d = z[k] + 1 - m[:4]
        assert np.allclose(mean[k], m) and np.allclose(cov[k], c)
        assert np.allclose(again[0][k], m + gain @ d) and np.allclose(again[1][k], c - gain @ s @ gain.T)
        assert np.allclose(moving.Extent.gate(mean, cov, z + 1)[k, k], d @ np.linalg.inv(s) @ d)


def test_rows_with_columns_of_their_own_need_no_paths():
    cost = np.array([[3.0, 1.0, 1.0], [np.nan, np.inf, 5.0]])
    assert [x.tolist() for x in assignment.assign(cost)] == [[0, 1], [1, 2]] and [x.tolist() for x in assignment.assign(cost.T)] == [[1, 2], [0, 1]]
    assert [x.tolist() for x in assignment.assign(np.array([[np.nan, np.nan, 2.0]]))] == [[0], [2]]


def test_gaps_are_cut_after_one_sort(spark):
    values = [(0, [1.0, 9.0, 17.0, 25.0, 26.0]), (1, [0.0, 4.0, 8.0, 12.0]), (2, [5.0]), (3, [0.0, 1.0]), (4, [None, 3.0, 20.0])]
    rows = spark.createDataFrame([(g, v) for g, some in values for v in some], "g long, v double")
    out = windows.gap_split(rows, "g", "v", [], 8.0, 10.0)
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], []).append(((r["v"] is not None, r["v"]), r["part"], r["n_parts"]))
    assert {g: [p for _, p, _ in sorted(some)] for g, some in got.items()} == {0: [0, 0, 1, 2, 2], 1: [0, 1, 1, 1], 2: [None], 3: [0, 0], 4: [0, 0, 1]}
    assert {g: {n for _, _, n in some} for g, some in got.items()} == {0: {3}, 1: {2}, 2: {None}, 3: {1}, 4: {2}}
    assert [p for _, p in sorted((r["v"], r["part"]) for r in windows.gap_split(rows.where("g = 0"), "g", "v", [], 8.0, 10.0, most=1).collect())] == [0, 0, 0, 1, 1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Sort [") == 1


def test_visible_points_are_found_once(spark):
    points = "array(named_struct('x', id * 1D, 'y', 2D, 'c', 1D), named_struct('x', 9D, 'y', id + 5D, 'c', 0.5D), named_struct('x', 30D, 'y', 30D, 'c', 0D))"
    rows = spark.range(3).select(F.expr(points).alias("p"))
    moved = F.transform("p", lambda p: F.struct((p["x"] + 1).alias("x"), p["y"].alias("y"), p["c"].alias("c")))
    out = rows.select(preparation.keypoint_similarity(F.col("p"), moved, [0.1, 0.2, 0.3]).alias("s"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 1
    for k, r in enumerate(out.collect()):
        area, whole = (9 - k) * (k + 3), (30 - k) * 28
        turn = lambda some: (max(x - y for x, y in some) - min(x - y for x, y in some)) * (max(x + y for x, y in some) - min(x + y for x, y in some)) / 2
        two = [(k, 2), (9, k + 5)]
        growth = [whole / area] + ([turn([*two, (30, 30)]) / turn(two)] if turn(two) > 0.1 else [])
        scale = math.sqrt(area) * min(5, math.sqrt(min(growth)))
        assert math.isclose(r["s"], (math.exp(-1 / (2 * scale**2 * 0.01)) + math.exp(-1 / (2 * scale**2 * 0.04))) / 2, rel_tol=1e-9)


def test_label_documents_are_small_on_disk(spark, tmp_path, monkeypatch):
    from touchline import source_queries

    monkeypatch.setattr(source_queries, "scratch", lambda _: str(tmp_path / "docs"))
    rows = source_queries.labels_round_trip(spark, "/root/testdata/sf0.001")
    files = [p for p in (tmp_path / "docs").rglob("part-*")]
    assert files and all(p.suffix == ".gz" for p in files) and rows.count() > 4000
    assert rows.agg(F.countDistinct("clip")).first()[0] == len(files)


def test_folds_of_few_bytes_stay_spread(spark):
    rows = spark.range(400).select((F.col("id") % 40).alias("v"), (F.col("id") % 10).alias("f"))
    out = frames.fold(rows, "v", "f", dict, lambda state, pdf: pdf[["v"]], "v long").withColumn("p", F.spark_partition_id())
    assert out.agg(F.countDistinct("p"), F.count("*")).first()[:] == (4, 400)
