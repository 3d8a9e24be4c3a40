from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.evaluation import tracking
from touchline.operators import frames, merge, ordered, ranking, tracklets


def table(spark, n, seed, group=False):
    rng = random.Random(seed)
    score = lambda: None if rng.random() < 0.05 else 7.0 if rng.random() < 0.4 else round(rng.random() * 20, 1)
    return [(i, score(), rng.random() < 0.3, rng.choice("ab") if group else "a") for i in range(n)]


@pytest.mark.parametrize("n,ranges", [(0, 8), (1, 8), (400, 8), (400, 50)])
def test_running_sums_with_a_hot_value(spark, n, ranges):
    data = table(spark, n, n + ranges, True)
    df = spark.createDataFrame(data, "id long, score double, hit boolean, g string")
    got = ordered.running(df, "score", ["id"], {"hits": F.col("hit"), "seen": F.lit(1)}, True, "g", "id", ranges).collect()
    want = {}
    for g in "ab":
        rows = sorted((r for r in data if r[3] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        for k, r in enumerate(rows):
            want[r[0]] = (sum(x[2] for x in rows[: k + 1]), k + 1, sum(x[2] for x in rows), len(rows))
    assert {r["id"]: (r["hits"], r["seen"], r["hits_all"], r["seen_all"]) for r in got} == want


def test_hot_value_is_cut(spark):
    df = spark.range(1000).select("id", F.lit(1.0).alias("score"))
    bounds = ordered._bounds(df, {"s": F.col("score"), "t": F.col("id")}, 10)
    cells = df.select(ordered._cut(F.col("score"), bounds["s"]).alias("c"), ordered._cut(F.col("id"), bounds["t"]).alias("p"))
    assert cells.groupBy("c", "p").count().agg(F.max("count")).first()[0] <= 120


def test_numbers_of_strings_and_numbers(spark):
    names = ["", "a", "ab", "abcdefgh", "abcdefga", "abcdefg", "ä", "Z", "zz", "日本"]
    got = ordered.numbered(spark.createDataFrame([(x,) for x in names], "k string"), ["k"], "no", 1).collect()
    assert {r["k"]: r["no"] for r in got} == {x: k + 1 for k, x in enumerate(sorted(names, key=str.encode))}
    df = spark.createDataFrame([("b", 3), ("a", 3), ("c", 1), ("b", 2)], "k string, t int")
    assert {r["k"]: r["dense_id"] for r in tracklets.dense_ids(df, "k", "t").collect()} == {"c": 0, "b": 1, "a": 2}
    assert ordered.numbered(spark.createDataFrame([], "k long"), ["k"], "no").count() == 0


def test_rebased_events(spark):
    df = spark.createDataFrame([("s2", 0, 5), ("s1", 2, 9), ("s1", 0, 5), ("s3", 1, None)], "seq string, frame long, id long")
    got = sorted((r["seq"], r["frame"], r["id"]) for r in merge.rebased_events(df, "seq", "frame", ["id"]).collect())
    assert got == [("s1", 0, 0), ("s1", 2, 1), ("s2", 3, 2), ("s3", 5, None)]


def test_areas_and_skyline(spark):
    rng = random.Random(3)
    data = [(i, float(rng.randint(0, 15)), rng.random() < 0.4) for i in range(200)]
    df = spark.createDataFrame(data, "id long, score double, hit boolean")
    curve = ranking.precision_recall(df, "score", F.col("hit"), "id").cache()
    rows = sorted(data, key=lambda r: (-r[1], r[0]))
    hits = np.cumsum([r[2] for r in rows])
    p, r = hits / np.arange(1, 201), hits / hits[-1]
    envelope = np.maximum.accumulate(p[::-1])[::-1]
    assert ranking.stepwise_ap(curve).first()[0] == pytest.approx(float((envelope * np.diff(np.append(0, r))).sum()))
    points = [(i, float(rng.randint(0, 30)), float(rng.randint(0, 30))) for i in range(150)]
    got = {(x["x"], x["y"]) for x in ranking.skyline(spark.createDataFrame(points, "id long, x double, y double"), "x", "y").collect()}
    assert got == {(x, y) for _, x, y in points if not any(a >= x and b >= y and (a, b) != (x, y) for _, a, b in points)}


def test_frames_that_batches_cut():
    rows = pd.DataFrame({"g": ["a"] * 6 + ["b"] * 3 + [None] * 2, "t": [1, 1, 2, 2, 2, 3, 1, 1, 2, 5, 5], "v": range(11)})
    for size in range(1, 12):
        parts = list(frames.whole_frames((rows.iloc[k : k + size] for k in range(0, 11, size)), "g", "t"))
        assert pd.concat([p for _, p in parts])["v"].tolist() == list(range(11))
        assert sum(new for new, _ in parts) == 3
        seen = [(g if isinstance(g, str) else None, t) for _, p in parts for g, t in {(g, t): 0 for g, t in zip(p["g"].where(p["g"].notna(), None), p["t"], strict=True)}]
        assert len(seen) == len(set(seen)) == 6


def test_folds_do_not_depend_on_batches(spark):
    rng = random.Random(8)
    gt = [(s, t, g) for s in ("x", "y") for t in range(30) for g in range(3) if rng.random() < 0.9]
    pred = [(s, t, p) for s in ("x", "y") for t in range(30) for p in range(10, 14) if rng.random() < 0.8]
    sim = [(s, t, g, p, rng.random()) for s, t, g in gt for s2, t2, p in pred if (s, t) == (s2, t2)]
    tables = spark.createDataFrame(sim, "seq string, t long, gt_id long, tracker_id long, sim double"), spark.createDataFrame(gt, "seq string, t long, gt_id long"), spark.createDataFrame(pred, "seq string, t long, tracker_id long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    found = []
    for size in ("7", before):
        spark.conf.set(key, size)
        pairs = tables[0].selectExpr("seq", "t as frame", "gt_id as oid", "tracker_id as hid", "1 - sim as distance").where("distance < 0.5")
        events = tracking.accumulate(pairs, tables[1].selectExpr("seq", "t as frame", "gt_id as oid"), tables[2].selectExpr("seq", "t as frame", "tracker_id as hid"))
        found.append((sorted(map(repr, tracking.clear(*tables).collect())), sorted(map(repr, events.collect()))))
    spark.conf.set(key, before)
    assert found[0] == found[1] and len(found[0][0]) == 2


def brute_merge(items, threshold):
    items = [([t], np.array(m), float(n), set(f)) for t, m, n, f in sorted(items)]
    while True:
        best = None
        for i in range(len(items)):
            for j in range(i + 1, len(items)):
                a, b = items[i], items[j]
                d = max(0.0, 1 - a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])))
                if d <= threshold and not a[3] & b[3] and (best is None or d < best[0]):
                    best = (d, i, j)
        if best is None:
            return {t: min(ts) for ts, *_ in items for t in ts}
        _, i, j = best
        a, b = items[i], items.pop(j)
        items[i] = (a[0] + b[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2], a[3] | b[3])


def test_agglomeration_follows_brute_force(spark):
    rng = np.random.default_rng(5)
    data = [("v", int(t), int(rng.integers(1, 9)), rng.normal(size=3).tolist(), rng.integers(0, 40, 2).tolist()) for t in range(25)]
    got = tracklets.agglomerate(spark.createDataFrame(data, "video string, track long, n long, mean array<double>, frames array<long>"), "video", 0.4)
    assert {r["track"]: r["merged"] for r in got.collect()} == brute_merge([(t, m, n, f) for _, t, n, m, f in data], 0.4)
