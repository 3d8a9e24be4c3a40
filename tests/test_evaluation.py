from __future__ import annotations

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline import queries
from touchline.evaluation import detection, tracking
from touchline.evaluation.assignment import assign, assign_above, greedy


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_assignment_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    r, c = assign(cost)
    assert len(r) == min(n, m) and len(set(r)) == len(r) and len(set(c)) == len(c)
    small, big = (cost, m) if n <= m else (cost.T, n)
    best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(big), len(small)))
    assert cost[r, c].sum() == best


def test_missing_edges_and_empty_matrices():
    r, c = assign(np.array([[np.nan, 1.0], [np.nan, 2.0]]))
    assert list(zip(r, c, strict=True)) == [(0, 1)]
    assert len(assign(np.zeros((0, 3)))[0]) == 0 and len(assign(np.full((2, 2), np.inf))[0]) == 0


def test_greedy_differs_from_optimal():
    s = np.array([[0.9, 0.8], [0.85, 0.1]])
    assert list(greedy(s, 0.5)[1]) == [0]
    assert list(assign_above(s, 0.5)[1]) == [1, 0]


def tables(spark, gt, pred, sim):
    return (
        spark.createDataFrame(sim, "seq string, t long, gt_id long, tracker_id long, sim double"),
        spark.createDataFrame(gt, "seq string, t long, gt_id long"), spark.createDataFrame(pred, "seq string, t long, tracker_id long"),
    )


def test_identical_tracks_score_one(spark):
    gt = [("s", t, i) for t in range(6) for i in (1, 2)]
    pred = [("s", t, i + 10) for t in range(6) for i in (1, 2)]
    sim = [("s", t, i, i + 10, 1.0) for t in range(6) for i in (1, 2)]
    args = tables(spark, gt, pred, sim)
    assert {(r["HOTA"], r["AssA"], r["DetA"], r["LocA"]) for r in tracking.hota(*args).collect()} == {(1.0, 1.0, 1.0, 1.0)}
    c = tracking.clear(*args).first()
    assert (c["MOTA"], c["idsw"], c["mt"], c["frag"]) == (1.0, 0, 2, 0)
    assert tracking.identity(*args).first()["IDF1"] == 1.0
    v = tracking.vace(*args).first()
    assert (v["ATA"], v["SFDA"]) == (1.0, 1.0)


def test_one_switch_in_the_middle(spark):
    gt = [("s", t, 1) for t in range(4)]
    pred = [("s", t, 10 if t < 2 else 11) for t in range(4)]
    sim = [("s", t, 1, 10 if t < 2 else 11, 1.0) for t in range(4)]
    args = tables(spark, gt, pred, sim)
    c = tracking.clear(*args).first()
    assert (c["idsw"], c["MOTA"]) == (1, 0.75)
    assert tracking.identity(*args).first()["IDF1"] == 0.5
    h = tracking.hota(*args).first()
    assert h["DetA"] == 1.0 and h["AssA"] == pytest.approx(0.5) and h["HOTA"] == pytest.approx(0.5**0.5)
    assert tracking.combined_hota(tracking.hota(*args)).count() == 19


def test_empty_sides(spark):
    args = tables(spark, [("a", 0, 1)], [("b", 0, 5)], [])
    assert {r["seq"]: (r["tp"], r["fn"], r["fp"]) for r in tracking.hota(*args).where("alpha = 0.5").collect()} == {"a": (0, 1, 0), "b": (0, 0, 1)}
    assert {r["seq"]: (r["idtp"], r["idfn"], r["idfp"]) for r in tracking.identity(*args).collect()} == {"a": (0, 1, 0), "b": (0, 0, 1)}
    assert {r["seq"]: (r["fn"], r["fp"]) for r in tracking.clear(*args).collect()} == {"a": (1, 0), "b": (0, 1)}


def test_events_and_metrics(spark):
    o = spark.createDataFrame([("s", f, 1) for f in range(3)], "seq string, frame long, oid long")
    h = spark.createDataFrame([("s", 0, 7), ("s", 1, 8), ("s", 1, 9)], "seq string, frame long, hid long")
    p = spark.createDataFrame([("s", 0, 1, 7, 0.1), ("s", 1, 1, 8, 0.3)], "seq string, frame long, oid long, hid long, distance double")
    e = tracking.accumulate(p, o, h)
    assert sorted((r["frame"], r["type"]) for r in e.collect()) == [(0, "MATCH"), (1, "FP"), (1, "SWITCH"), (2, "MISS")]
    m = tracking.event_metrics(e).first()
    assert (m["mota"], m["motp"], m["precision"], m["recall"]) == (pytest.approx(0.0), pytest.approx(0.2), pytest.approx(2 / 3), pytest.approx(2 / 3))


def test_greedy_matches_by_stored_order(spark):
    pairs = spark.createDataFrame([(1, 1, 5, 0.8), (1, 2, 5, 0.9), (1, 2, 6, 0.6)], "frame long, pred_id long, gt_id long, iou double")
    pred = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2)], "frame long, pred_id long, pos long")
    got = {(r["threshold"], r["pred_id"]): r["gt_id"] for r in detection.greedy_matches(pairs, pred, [0.5, 0.7]).collect()}
    assert got == {(0.5, 1): 5, (0.5, 2): 6, (0.5, 3): None, (0.7, 1): 5, (0.7, 2): None, (0.7, 3): None}


def test_perfect_ranking_has_ap_one(spark):
    m = spark.createDataFrame([(0.5, 1, 1, 4), (0.5, 1, 2, 5), (0.5, 1, 3, None)], "threshold double, frame long, pred_id long, gt_id long")
    s = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.1)], "frame long, pred_id long, score double")
    assert detection.average_precision(m, s, 2).first()["ap"] == pytest.approx(1.0)


def test_global_keypoint_and_path_scores(spark):
    gt = [(s, t, 1) for s in "ab" for t in range(3)]
    pred = [(s, t, 10 if s == "a" else 11) for s in "ab" for t in range(3)]
    sim = [(s, t, 1, 10 if s == "a" else 11, 1.0) for s in "ab" for t in range(3)]
    args = tables(spark, gt, pred, sim)
    assert {r["AssA"] for r in tracking.hota(*args).collect()} == {1.0}
    assert {r["AssA"] for r in tracking.global_hota(*args).collect()} == {0.5}  # two ids for one person
    joints = [d.withColumn("joint", d["seq"]) for d in args]
    assert {r["joint"] for r in tracking.keypoint_hota(*joints).collect()} == {"a", "b", "total"}
    at = spark.createDataFrame([("s", t, 1, float(3 * t), float(4 * t)) for t in range(4)], "seq string, t long, id long, x double, y double")
    m = spark.createDataFrame([("s", t, 1, 7 if t < 3 else 8) for t in range(4)], "seq string, t long, gt_id long, tracker_id long")
    assert tracking.path_consistency(at, m).first()["IDEucl"] == pytest.approx(2 / 3)
    assert tracking.fragmentation(m, at.withColumnRenamed("id", "gt_id").select("seq", "t", "gt_id")).first()["FragA"] == pytest.approx(2 / 3)


def test_predictions_without_any_truth_are_false_positives(spark, tmp_path):
    events = [(1, "2024-01-01 00:10:00", 1, "click", 50.0), (2, "2024-01-01 00:20:00", 1, "purchase", 50.0), (3, "2024-01-01 00:30:00", 5, "error", 500.0)]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    ap = {r["threshold"]: r["ap"] for r in queries.queries()["box_average_precision"](spark, str(tmp_path)).collect()}
    assert ap[0.5] == pytest.approx(0.5)
