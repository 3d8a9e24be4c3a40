from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline.operators import claims, integrity, joins, library, merge, ranking, tracklets, windows

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_vote_keeps_first_seen_on_a_tie_and_takes_null_as_a_value(spark):
    df = spark.createDataFrame([(1, "a", 0.5, 0), (1, "b", 0.5, 1), (2, None, 0.9, 2), (2, "c", 0.1, 3)], "track long, v string, w double, pos long")
    got = tracklets.weighted_vote(df, "track", "v", "w", "pos")
    assert {r["track"]: r["v"] for r in got.collect()} == {1: "a", 2: None}


@QUICK
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 9)), min_size=1, max_size=8))
def test_vote_ignores_repetition_of_the_winner(spark, votes):
    make = lambda v: spark.createDataFrame([(1, a, float(w), k) for k, (a, w) in enumerate(v)], "track long, v string, w double, pos long")
    won = tracklets.weighted_vote(make(votes), "track", "v", "w", "pos").first()["v"]
    again = tracklets.weighted_vote(make(votes + [(won, 9)]), "track", "v", "w", "pos").first()["v"]
    assert again == won


def test_neighbour_filter(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(["a", "b", "b", "c", "b"])], "track long, frame long, v string")
    assert [r["frame"] for r in tracklets.neighbour_supported(df, "track", "v", ["frame"]).orderBy("frame").collect()] == [1, 2]


def test_merge_by_mode_respects_shared_frames(spark):
    df = spark.createDataFrame([(1, 1, 9), (2, 2, 9), (3, 1, 7), (4, 1, 7)], "track long, frame long, n int")
    got = tracklets.merge_by_mode(df, "track", "n", "frame").select("track", "merged").distinct()
    assert rows(got) == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_mean_vector_skips_malformed(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (1, [9.0]), (1, [float("nan"), 0.0]), (2, None)], "track long, v array<double>")
    assert {r["track"]: r["mean"] for r in tracklets.mean_vector(df, "track", "v", 2).collect()} == {1: [2.0, 3.0], 2: None}


def test_two_clusters_and_agglomeration(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.1, 1.0]), (3, [9.0, 0.0]), (4, None)], "track long, mean array<double>")
    assert {r["track"]: r["cluster"] for r in tracklets.two_clusters(df, "track").collect()} == {1: 0, 2: 0, 3: 1, 4: None}
    assert tracklets.two_clusters(df.where("track = 1"), "track").first()["cluster"] == 0
    t = spark.createDataFrame([("v", 1, 5, [1.0, 0.0], [1, 2]), ("v", 2, 5, [1.0, 0.01], [3]), ("v", 3, 5, [1.0, 0.3], [2]), ("v", 4, 1, [0.0, 1.0], [9])], "video string, track long, n long, mean array<double>, frames array<long>")
    assert rows(tracklets.agglomerate(t, "video", 0.1)) == [("v", 1, 1), ("v", 2, 1), ("v", 3, 3), ("v", 4, 4)]


def test_team_sides(spark):
    df = spark.createDataFrame([(0, -10.0, "player"), (1, 20.0, "player"), (1, -5.0, "goalkeeper"), (None, 1.0, "player")], "c int, x double, role string")
    assert [r["side"] for r in tracklets.team_sides(df, "c", "x", "role").orderBy("x").collect()] == ["left", "left", None, "right"]


def test_outside_tracks_go(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 99.0, 0.0), (1, 99.0, 0.0), (2, 0.0, 0.0), (2, 99.0, 0.0), (3, None, None), (None, 99.0, 0.0)], "track long, x double, y double")
    assert {r["track"] for r in tracklets.drop_outside(df, "track", "x", "y", 62.5, 39.0).collect()} == {2, 3, None}


def test_uniform_sample_includes_both_ends(spark):
    df = spark.createDataFrame([(1, k) for k in range(11)], "track long, frame long")
    assert [r["frame"] for r in tracklets.uniform_sample(df, "track", ["frame"], 3).orderBy("frame").collect()] == [0, 5, 10]


def test_upsert_never_nulls(spark):
    left = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, v string, w int")
    right = spark.createDataFrame([(2, None, "x"), (3, "c", "y")], "id long, v string, z string")
    assert rows(merge.upsert_merge(left, right, "id").na.fill({"w": -1, "z": "-"})) == [(1, "a", 1, "-"), (2, "b", 2, "x"), (3, "c", -1, "y")]


@QUICK
@given(st.dictionaries(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 9)), min_size=1), st.dictionaries(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 9)), min_size=1))
def test_upsert_keeps_every_value_that_is_not_overridden(spark, a, b):
    df = lambda d: spark.createDataFrame(list(d.items()), "id long, v long")
    got = {r["id"]: r["v"] for r in merge.upsert_merge(df(a), df(b), "id").collect()}
    assert got == {k: b[k] if b.get(k) is not None else a.get(k) for k in {*a, *b}}


def test_set_operators(spark):
    ids = lambda *v: spark.createDataFrame([(x, f"n{x}") for x in v], "id long, name string")
    assert rows(merge.union_first([ids(1, 2), ids(2, 3)], "id")) == [(1, "n1"), (2, "n2"), (3, "n3")]
    assert rows(merge.subtract(ids(1, 2), ids(2), "id")) == [(1, "n1")]
    assert rows(merge.differences(ids(1, 2), ids(2, 3), "id")) == [(1, "left"), (2, "both"), (3, "right")]
    assert rows(merge.replace_by_key(ids(1, 2), ids(2).withColumn("name", F.lit("x")), ["id"])) == [(1, "n1"), (2, "x")]
    with pytest.raises(ValueError, match="missing"):
        merge.checked_manifest(ids(1), ids(1, 4), "id")
    with pytest.raises(Exception, match="repeats"):
        merge.one_to_one(ids(1, 1), ids(1), "id", []).collect()


def test_interval_join_strict_and_inclusive(spark):
    a = spark.createDataFrame([(1, 0.0, 10.0), (2, 10.0, 25.0), (3, 100.0, 101.0)], "a long, s double, e double")
    b = spark.createDataFrame([(7, 10.0, 12.0), (8, 5.0, 30.0)], "b long, f double, g double")
    join = lambda inclusive: rows(joins.interval_join(a, b, ("s", "e"), ("f", "g"), 4.0, inclusive=inclusive).select("a", "b"))
    assert join(False) == [(1, 8), (2, 7), (2, 8)]
    assert join(True) == [(1, 7), (1, 8), (2, 7), (2, 8)]


@QUICK
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 15)), min_size=1, max_size=6), st.lists(st.tuples(st.integers(0, 40), st.integers(1, 15)), min_size=1, max_size=6), st.integers(1, 20))
def test_interval_join_is_symmetric_and_complete(spark, xs, ys, width):
    frame = lambda v, i, s, e: spark.createDataFrame([(k, float(a), float(a + n)) for k, (a, n) in enumerate(v)], f"{i} long, {s} double, {e} double")
    a, b = frame(xs, "a", "s", "e"), frame(ys, "b", "f", "g")
    want = sorted((i, j) for i, (p, n) in enumerate(xs) for j, (q, m) in enumerate(ys) if p < q + m and q < p + n)
    assert rows(joins.interval_join(a, b, ("s", "e"), ("f", "g"), width).select("a", "b")) == want
    assert rows(joins.interval_join(b, a, ("f", "g"), ("s", "e"), width).select("a", "b")) == want


def test_asof_takes_the_latest_start(spark):
    e = spark.createDataFrame([(1, 5.0), (2, 50.0)], "event_key long, t double")
    w = spark.createDataFrame([(0.0, 10.0, "x"), (5.0, 9.0, "y"), (6.0, 9.0, "z")], "s double, e double, name string")
    assert rows(joins.asof_latest(e, w, "t", ("s", "e"), 3.0).select("event_key", F.coalesce("name", F.lit("-")))) == [(1, "y"), (2, "-")]


def test_nearest_prefers_within_the_limit(spark):
    p = spark.createDataFrame([(1, 1, 0.0)], "point_key long, g long, x double")
    c = spark.createDataFrame([(1, 1.0, "keeper", 0), (1, 3.0, "player", 1), (1, -3.0, "player", 2)], "g long, cx double, role string, pos long")
    d = F.abs(F.col("cx") - F.col("x"))
    assert joins.nearest(p, c, "g", d, "pos", 5.0).first()["role"] == "keeper"
    assert joins.nearest(p, c, "g", d, "pos", 5.0, F.col("role") == "player").first()["pos"] == 1
    assert joins.nearest(p, c, "g", d, "pos", 2.0, F.col("role") == "player").first()["role"] == "keeper"
    assert joins.nearest(p, c, "g", d, "pos", 0.5).first()["role"] is None


def test_islands_sessions_and_dropouts(spark):
    frames = [(1, k, 0 if 3 <= k < 8 else 12, not 3 <= k < 8) for k in range(12)]
    df = spark.createDataFrame(frames, "v long, f long, n long, ok boolean")
    got = windows.calibration_dropouts(df, "v", "f", F.col("ok"), "n").first()
    assert (got["first"], got["last"], got["n"]) == (3, 7, 5)
    four = df.where("f <> 7")
    assert windows.calibration_dropouts(four, "v", "f", F.col("ok"), "n").count() == 0
    s = spark.createDataFrame([(1, f) for f in (1, 2, 3, 7, 8)], "t long, f long")
    assert rows(windows.frame_sessions(s, ["t"], "f", 3)) == [(1, 1, 3, 3, False), (1, 7, 8, 2, True)]


def test_gap_split_rules(spark):
    df = spark.createDataFrame([("a", v) for v in (0.0, 1.0, 7.0, 8.0, 20.0)] + [("b", 0.0), ("b", 3.0), ("b", 6.5)] + [("c", 1.0)], "g string, v double")
    got = {(r["g"], r["v"]): (r["part"], r["n_parts"]) for r in windows.gap_split(df, "g", "v", [], 4.5, 6.0).collect()}
    assert [got["a", v][0] for v in (0.0, 1.0, 7.0, 8.0, 20.0)] == [0, 0, 1, 1, 2]
    assert [got["b", v][0] for v in (0.0, 3.0, 6.5)] == [0, 0, 1]
    assert got["c", 1.0] == (None, None)


def test_trailing_frames(spark):
    df = spark.createDataFrame([(1, f, v) for f, v in ((1, 10.0), (2, 10.0), (3, 20.0), (5, 99.0))], "t long, f long, v double")
    assert [r["outlier"] for r in windows.trailing_outliers(df, "t", "f", "v").orderBy("f").collect()] == [False, False, True, False]
    ids = spark.createDataFrame([(1, f, "a" if f < 7 else "b") for f in range(10)], "t long, f long, m string")
    assert [r["majority"] for r in windows.trailing_majority(ids, "t", "f", "m").orderBy("f").collect()] == [None] * 6 + ["a"] * 4


def test_paths_jumps_and_fragments(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 3.0, 5.0), (1, 3, 900.0, 5.0)], "o long, f long, x double, y double")
    assert windows.path_length(df.where("f < 3"), "o", ["f"], "x", "y").first()["length"] == 6
    near = windows.until_jump(df.withColumn("p", F.lit(1)), "o", "f", "x", "y", "p", 200.0)
    assert sorted(r["f"] for r in near.collect()) == [0, 1, 2]
    t = spark.createDataFrame([(1, k, bool(v)) for k, v in enumerate([0, 1, 0, 0, 1, 0])], "o long, f long, t boolean")
    assert windows.fragments(t, "o", ["f"], F.col("t")).first()["n_fragments"] == 1


def test_suppression_and_slots(spark):
    b = spark.createDataFrame([(1, 1, 0.9, [0.0, 0.0, 10.0, 10.0]), (1, 2, 0.8, [1.0, 0.0, 11.0, 10.0]), (1, 3, 0.7, [50.0, 0.0, 60.0, 10.0])], "frame long, box_id long, score double, box array<double>")
    assert sorted(r["box_id"] for r in ranking.suppress(b, "frame", 0.5).collect()) == [1, 3]
    c = [("s", "A", 2015, 1, 0, 90.0, 5.0, "p1"), ("s", "A", 2015, 1, 0, 80.0, 5.0, "p2"), ("s", "B", 2016, 1, 0, 80.0, 5.0, "p3"), ("s", "C", 2017, 0, 0, 99.0, 5.0, "p4")]
    df = spark.createDataFrame(c, "slot string, team string, edition int, n_spans int, n_gaps int, confidence double, duration double, path string")
    assert [r["path"] for r in ranking.diverse_slots(df, "slot", "team", "edition", 3).orderBy("place").collect()] == ["p1", "p3", "p2"]


def test_claims(spark):
    c = spark.createDataFrame([("c1", "t", 0.0, 5.0, True), ("c1", "u", 0.0, 5.0, False), ("c2", "t", 0.0, 5.0, True)], "clip_uid string, tactic_id string, start_s double, end_s double, truth boolean")
    spans = "array<struct<start_s: double, end_s: double>>"
    r = spark.createDataFrame([("c1", [("t", "present", 90.0, [(4.5, 6.0)]), ("u", "present", 90.0, [(5.0, 6.0)])])], f"clip_uid string, assessments array<struct<tactic_id: string, verdict: string, confidence: double, evidence_spans: {spans}>>")
    got = {(x["clip_uid"], x["tactic_id"]): (x["covered"], x["predicted"]) for x in claims.matched_claims(c, r, 0).collect()}
    assert got == {("c1", "t"): (True, True), ("c1", "u"): (True, False), ("c2", "t"): (False, False)}
    m = claims.claim_metrics(claims.matched_claims(c, r, 0)).first()
    assert (m["precision"], m["recall"], m["accuracy"], m["coverage"]) == (1.0, 0.5, None, pytest.approx(2 / 3))
    none = claims.claim_metrics(claims.matched_claims(c, r, 95)).first()
    assert none["precision"] is None and none["f1"] == 0.0


def test_sample_votes(spark):
    s = [("a", "present", 90.0, 0), ("a", "absent", 75.0, 1), ("a", "present", 70.0, 2), ("b", "absent", 80.0, 0), ("b", "present", 70.0, 1), ("b", "absent", 60.0, 2)]
    df = spark.createDataFrame(s, "card string, verdict string, confidence double, pos long")
    got = {r["card"]: (r["verdict"], r["confidence"], r["representative"]) for r in claims.sample_vote(df, ["card"], "verdict", "confidence", "pos").collect()}
    assert got == {"a": ("present", 80.0, 0), "b": ("absent", 70.0, 0)}
    with pytest.raises(Exception, match="odd"):
        claims.sample_vote(df.where("pos < 2"), ["card"], "verdict", "confidence", "pos").collect()


def test_library(spark):
    f = spark.createDataFrame([("a/1", "x", False), ("b/1", "x", True), ("c/1", "y", False)], "path string, body string, ok boolean")
    got = {r["path"]: (r["canonical"], r["duplicate"]) for r in library.canonical(f, F.sha2("body", 256), "path", F.col("ok")).collect()}
    assert got == {"a/1": ("b/1", True), "b/1": ("b/1", False), "c/1": ("c/1", False)}
    old, new = (spark.createDataFrame(v, "k long, version string") for v in ([(1, "a"), (2, "a")], [(1, "a"), (2, "b"), (3, "b")]))
    assert rows(library.migration_status(old, new, "k", "version").select("k", "status")) == [(1, "existing"), (2, "stale"), (3, "pending")]
    with pytest.raises(Exception, match="unknown decision"):
        library.approved_reviews(spark.createDataFrame([("maybe", 1)], "d string, x long"), "d", ["x"]).collect()


def test_integrity(spark):
    df = spark.createDataFrame([(1, 5), (2, -1)], "id long, v long")
    good, bad = integrity.split_rejects(df, {"negative": F.col("v") < 0})
    assert rows(good) == [(1, 5)] and bad.first()["findings"] == ["negative"]
    ids = spark.createDataFrame([(1, 7), (1, 7), (2, 7)], "frame long, track long").withColumn("pos", F.monotonically_increasing_id())
    assert sorted(r["track"] for r in integrity.repaired_track_ids(ids, "frame", "track", ["pos"]).collect()) == [7, 7, 100_007]
