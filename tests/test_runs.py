"""Metric registry, evaluation runs, poses."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from touchline.evaluation import pose, registry, run, tracking
from touchline.functions import boxes


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    rows = []
    for s in range(4):
        for f in range(30):
            for o in range(5):
                kind = rng.choice(["MATCH"] * (1 + 2 * o) + ["SWITCH", "MISS", "MISS"])
                rows.append((f"s{s}", f, kind, o, None if kind == "MISS" else rng.randint(0, 9), None if kind == "MISS" else rng.random()))
            if rng.random() < 0.4:
                rows.append((f"s{s}", f, "FP", None, rng.randint(0, 9), None))
    return spark.createDataFrame(rows, "seq string, frame long, type string, oid long, hid long, distance double").cache()


def test_registry_agrees_with_direct_calls(events):
    r = registry.tracking_registry()
    asked = ["mota", "motp", "precision", "recall", "num_matches", "mostly_tracked", "partially_tracked", "mostly_lost", "num_unique_objects", "f1"]
    got = {x["seq"]: x for x in r.compute(events, asked, ["seq"]).collect()}
    for x in tracking.event_metrics(events, ["seq"]).collect():
        for a, b in {"mota": "mota", "motp": "motp", "precision": "precision", "recall": "recall", "matches": "num_matches"}.items():
            assert got[x["seq"]][b] == pytest.approx(x[a])
    for x in tracking.tracked_buckets(events, ["seq"]).collect():
        assert [got[x["seq"]][c] for c in ("mostly_tracked", "partially_tracked", "mostly_lost", "num_unique_objects")] == [x[c] for c in ("mostly_tracked", "partially_tracked", "mostly_lost", "objects")]
    many = {x["seq"]: x for x in r.compute_many(events, asked, "seq").collect()}
    whole = tracking.event_metrics(events).first()
    assert many["OVERALL"]["mota"] == pytest.approx(whole["mota"]) and many["OVERALL"]["motp"] == pytest.approx(whole["motp"])
    assert {k: v for k, v in many.items() if k != "OVERALL"}.keys() == got.keys() and many["s1"]["f1"] == pytest.approx(got["s1"]["f1"])
    parts = r.partials(events, asked, ["seq"])
    overall = r.compute_overall(parts, asked).first()
    assert all(overall[c] == pytest.approx(many["OVERALL"][c]) for c in asked)


def test_registry_scans_once_and_names_what_is_wrong(events):
    r = registry.tracking_registry()
    plan = r.compute_many(events.sparkSession.createDataFrame(events.rdd, events.schema), ["mota", "motp", "f1", "mostly_lost"], "seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    with pytest.raises(ValueError, match="registered already"):
        r.counter(lambda type: F.count(type), name="num_matches")
    r.measure(lambda b: b, name="a")
    r.measure(lambda a: a, name="b")
    with pytest.raises(ValueError, match="a -> b -> a"):
        r.compute(events, ["a"])
    with pytest.raises(KeyError, match="nothing"):
        r.compute(events, ["nothing"])
    r.measure(lambda gone: gone, name="c")
    with pytest.raises(KeyError, match="c needs the metric gone"):
        r.compute(events, ["c"])
    r.per_object(lambda mota: F.max(mota), name="d")
    with pytest.raises(ValueError, match="only need counters"):
        r.compute(events, ["d"])


def test_own_metrics_with_merges(events):
    r = registry.Registry()

    @r.counter(merge=F.max)
    def last_frame(frame):
        """The last frame with an event."""
        return F.max(frame)

    @r.counter
    def rows(type):
        return F.count(type)

    @r.measure
    def rows_per_frame(rows, last_frame):
        return rows / (last_frame + 1)

    got = r.compute_many(events, ["rows_per_frame", "last_frame"], "seq", overall="all").where("seq = 'all'").first()
    assert got["last_frame"] == 29 and got["rows_per_frame"] == pytest.approx(events.count() / 30)
    assert r.metrics["last_frame"].help.startswith("The last") and r.metrics["rows_per_frame"].needs == ("rows", "last_frame")


def tables(spark, broken=()):
    rng = random.Random(3)
    gt, pred = [], []
    for s in ("a", "b", "c"):
        for t in range(12):
            for i in range(3):
                box = [100.0 * i + t, 0.0, 100.0 * i + t + 40, 80.0]
                gt.append((s, t, i, box))
                for name, slip in (("good", 2), ("bad", 25)):
                    if rng.random() < 0.9:
                        pred.append((name, s, t, i + 10, [box[0] + rng.uniform(0, slip), 0.0, box[2], 80.0]))
    gt += [x for x in broken if len(x) == 4]
    pred += [x for x in broken if len(x) == 5]
    return spark.createDataFrame(gt, "seq string, t long, gt_id long, box array<double>"), spark.createDataFrame(pred, "tracker string, seq string, t long, tracker_id long, box array<double>")


def test_a_run_is_what_the_metrics_give(spark):
    gt, pred = tables(spark)
    results, errors = run.evaluate(gt, pred, ["HOTA", "CLEAR", "Identity"])
    assert errors.count() == 0
    got = {(r["tracker"], r["seq"], r["metric"], r["alpha"], r["field"]): r["value"] for r in results.collect()}
    one = pred.where("tracker = 'good'")
    sim = gt.join(one.withColumnRenamed("box", "b"), ["seq", "t"]).select("seq", "t", "gt_id", "tracker_id", boxes.iou(F.col("box"), F.col("b")).alias("sim")).where("sim > 0")
    sides = gt.select("seq", "t", "gt_id"), one.select("seq", "t", "tracker_id")
    for r in tracking.clear(sim, *sides).collect():
        assert got["good", r["seq"], "CLEAR", None, "MOTA"] == pytest.approx(r["MOTA"])
    for r in tracking.combined_hota(tracking.hota(sim, *sides)).collect():
        assert got["good", run.COMBINED, "HOTA", r["alpha"], "HOTA"] == pytest.approx(r["HOTA"])
    assert got["good", run.COMBINED, "Count", None, "gt_dets"] == 108
    table = {r["tracker"]: r for r in run.summary(results).collect()}
    assert table["good"]["HOTA"] > table["bad"]["HOTA"] and 0 < table["bad"]["IDF1"] <= 100
    with pytest.raises(KeyError, match="Nothing"):
        run.evaluate(gt, pred, ["Nothing"])


def test_a_broken_sequence_leaves_the_others(spark):
    box = [0.0, 0.0, 1.0, 1.0]
    gt, pred = tables(spark, [("good", "b", 0, 10, box), ("good", "b", 0, 10, box), ("bad", "c", 3, None, box), ("bad", "c", 4, 99, [0.0, 0.0, float("nan"), 1.0]), ("bad", "zz", 0, 1, box)])
    results, errors = run.evaluate(gt, pred, ["CLEAR"])
    assert sorted(tuple(r) for r in errors.select("tracker", "seq", "error").collect()) == [
        ("bad", "c", "predictions: 1 broken boxes"), ("bad", "c", "predictions: 1 rows without an id or a frame"),
        ("bad", "zz", "predictions: the truth has no such sequence"), ("good", "b", "predictions: 1 ids more than once in a frame"),
    ]
    found = sorted({(r["tracker"], r["seq"]) for r in results.collect()})
    assert found == [("bad", "COMBINED"), ("bad", "a"), ("bad", "b"), ("good", "COMBINED"), ("good", "a"), ("good", "c")]
    both, errors = run.evaluate(*tables(spark, [("c", 0, 0, box), ("c", 0, 0, box)]), ["CLEAR"])
    assert {(r["tracker"], r["seq"]) for r in errors.collect()} == {("good", "c"), ("bad", "c")}


def test_selected_rows(spark):
    points = lambda *c: [(float(k), 0.0, float(v)) for k, v in enumerate(c)]
    rows = [(1, 5, False, points(1, 1, 0)), (2, 5, None, points(1, 1, 1)), (3, 5, True, points(1, 1, 1)), (4, 6, False, points(1, 1, 1)), (5, None, False, points(1, 1, 1)), (6, 5, False, points(1, 0, 0)), (7, 6, False, None)]
    df = spark.createDataFrame(rows, "id long, track long, ignored boolean, points array<struct<x: double, y: double, c: double>>")
    ids = lambda **k: sorted(r["id"] for r in run.selected(df, ["points"], ignored="ignored", points="points", least_points=2, **k).collect())
    assert ids() == [1, 2, 4, 5] and ids(track="track", least_rows=2) == [1, 2, 5]
    assert sorted(r["id"] for r in run.selected(df, ["points", "track"]).collect()) == [1, 2, 3, 4, 6]


def test_poses(spark):
    p = lambda *at: [(float(x), float(y), float(c)) for x, y, c in at]
    truth = spark.createDataFrame([(0, 0, p((10, 10, 0), (20, 20, 0)), 4.0), (0, 1, p((50, 50, 0), (0, 0, 0)), 4.0)], "frame long, gt_id long, points array<struct<x: double, y: double, c: double>>, head double")
    said = [(0, 0, p((11, 10, 0.9), (20, 30, 0.8))), (0, 1, p((10, 10, 0.5), (20, 20, 0.5))), (0, 2, p((51, 51, 0.7), (5, 5, 0.6))), (1, 0, p((9, 9, 0.95), (0, 3, 0.1)))]
    predicted = spark.createDataFrame(said, "frame long, pred_id long, points array<struct<x: double, y: double, c: double>>")
    got = {(r["gt_id"], r["pred_id"]): r["share"] for r in pose.pose_matches(truth, predicted).collect()}
    assert got == {(0, 1): 1.0, (1, 2): 1.0}
    out = {r["part"]: r for r in pose.pose_precision(truth, predicted, 0.5, {"first": [0], "second": [1]}, 2).collect()}
    # first joint in falling score: false 0.95, false 0.9, true 0.7, true 0.5; second: false 0.8, false 0.6, true 0.5
    assert out["first"]["ap"] == pytest.approx(50) and out["first"]["precision"] == pytest.approx(50) and out["first"]["recall"] == pytest.approx(100)
    assert out["second"]["ap"] == pytest.approx(100 / 3) and out["Total"]["ap"] == pytest.approx((50 + 100 / 3) / 2)
    none = pose.pose_precision(truth, predicted.where("frame > 9"), 0.5, {"first": [0]}, 2).collect()
    assert {(r["part"], r["ap"]) for r in none} == {("first", 0.0), ("Total", 0.0)}


def test_sparse_assignments_are_the_dense_ones():
    import numpy as np

    from touchline.evaluation.assignment import assign, assign_sparse

    rng = np.random.default_rng(2)
    for k in range(60):
        n, m = rng.integers(1, 14, 2)
        dense = np.where(rng.random((n, m)) < 0.15 + 0.1 * (k % 4), rng.integers(1, 9, (n, m)), 0)
        r, c = np.nonzero(dense)
        order = rng.permutation(len(r))
        r, c = r[order], c[order]
        taken = assign_sparse(r * 7, c + 100, dense[r, c])
        assert len(set(r[taken])) == taken.sum() == len(set(c[taken]))
        a, b = assign(-dense.astype(float))
        assert dense[r, c][taken].sum() == dense[a, b].sum()
    # a hundred thousand ids on either side, which a matrix would not hold
    ids = np.arange(100_000)
    rows, columns = np.concatenate([ids, ids]), np.concatenate([ids, ids // 2 * 2])
    assert assign_sparse(rows[ids.size :], columns[ids.size :], np.ones(ids.size)).sum() == 50_000


def test_set_matches(spark):
    import itertools

    import numpy as np

    from touchline.evaluation import detection

    rng = np.random.default_rng(5)
    preds = [(s, p, rng.normal(size=3).tolist(), rng.uniform(0.2, 0.8, 4).tolist()) for s in range(4) for p in range(4)]
    targets = [(s, t, int(rng.integers(0, 3)), rng.uniform(0.2, 0.8, 4).tolist()) for s in range(4) for t in range(s)]

    def cost(p, t):
        q = 1 / (1 + np.exp(-p[2][t[2]]))
        focal = 0.25 * (1 - q) ** 2 * -np.log(q + 1e-8) - 0.75 * q**2 * -np.log(1 - q + 1e-8)
        corners = lambda b: (b[0] - b[2] / 2, b[1] - b[3] / 2, b[0] + b[2] / 2, b[1] + b[3] / 2)
        a, b = corners(p[3]), corners(t[3])
        i = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        u = p[3][2] * p[3][3] + t[3][2] * t[3][3] - i
        hull = (max(a[2], b[2]) - min(a[0], b[0])) * (max(a[3], b[3]) - min(a[1], b[1]))
        return focal + sum(abs(x - y) for x, y in zip(p[3], t[3], strict=True)) - (i / u - (hull - u) / hull)

    got = detection.set_matches(
        spark.createDataFrame(preds, "sample long, pred_id long, logits array<double>, box array<double>"), spark.createDataFrame(targets, "sample long, target_id long, label int, box array<double>")
    ).collect()
    for s in range(4):
        own, wanted = [p for p in preds if p[0] == s], [t for t in targets if t[0] == s]
        best = min((sum(cost(p, t) for p, t in zip(way, wanted, strict=True)) for way in itertools.permutations(own, len(wanted))), default=0)
        mine = [r for r in got if r["sample"] == s]
        assert len(mine) == len(wanted) and sum(r["cost"] for r in mine) == pytest.approx(best)
