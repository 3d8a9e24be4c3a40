from __future__ import annotations

import pytest

from touchline.plans import stage, topology

SCHEMA = "clip string, frame long, track_id long, team string, role string, jersey_number int, x double, y double, pos long"


def detections(keepers=True, until=None):
    out = []
    for f in range(25):
        people = [(1, "left", "player", 6, -5, -10), (2, "left", "player", 8, -5, 10), (3, "left", "player", 9, 10, -10), (4, "left", "player", 11, 10, 10), (5, "right", "player", 4, 20, -10), (6, "right", "player", 5, 20, 10), (7, "right", "player", 7, 5, -10), (8, "right", "player", 10, 5, 10)]
        if keepers:
            people += [(90, "left", "goalkeeper", None, -50, 0), (91, "right", "goalkeeper", None, 50, 0)]
        people.append((99, None, "ball", None, -5, -10))
        out += [("c", f, t, team, role, j, float(x), float(y), k) for k, (t, team, role, j, x, y) in enumerate(people) if until is None or t != 4 or f < until]
    return out


def first_window(spark, **kw):
    df = spark.createDataFrame(detections(**kw), SCHEMA)
    found = topology.lines(df, 25.0)
    return df, found, {r["line"]: r for r in found.where("window = 0").collect()}


def test_first_window_lines_zones_and_ball(spark):
    df, found, lines = first_window(spark)
    assert {k: v["status"] for k, v in lines.items()} == dict.fromkeys(("attacking_forward", "attacking_midfield", "defending_defensive"), "renderable")
    assert {m["track_id"] for m in lines["attacking_forward"]["members"]} == {3, 4}
    assert {r["type"] for r in topology.zones(found).where("window = 0").collect()} == {"unit_band", "inter_line_space"}
    ball = topology.ball_summary(df, 25.0).where("window = 0").first()
    assert (ball["x_m"], ball["y_m"], ball["displacement_m"], ball["sample_count"]) == (-5.0, -10.0, 0.0, 25)
    d = topology.digest(found).where("window = 0").first()
    assert (d["forward_x"], d["midfield_x"], d["last_x"], d["gap"]) == (10.0, -5.0, 20.0, 25.0) or d["last_x"] in (5.0, 20.0)


def test_a_member_that_leaves_makes_the_line_a_candidate(spark):
    _, _, lines = first_window(spark, until=14)
    assert lines["attacking_forward"]["status"] == "candidate"
    assert [m["track_id"] for m in lines["attacking_forward"]["members"]] == [3]


def test_without_keepers_directions_are_not_trusted(spark):
    _, _, lines = first_window(spark, keepers=False)
    assert {v["status"] for v in lines.values()} == {"candidate"}
    assert all("attack direction inferred only from team label" in v["evidence_gaps"] for v in lines.values())


def test_possession_needs_a_near_ball(spark):
    df = spark.createDataFrame([r for r in detections() if r[4] != "ball"], SCHEMA)
    assert topology.possession(df).where("possession is not null").isEmpty()
    far = spark.createDataFrame([(*r[:6], 40.0, 33.0, r[8]) if r[4] == "ball" else r for r in detections()], SCHEMA)
    assert topology.possession(far).where("possession is not null").isEmpty()


def test_windows_between_are_strict(spark):
    _, found, _ = first_window(spark)
    spans = spark.createDataFrame([("c", 1.0, 1.2)], "clip string, start_s double, end_s double")
    assert {r["window"] for r in topology.windows_between(found, spans).collect()} == {1}


def test_stages_are_checked_before_they_run(spark):
    base = spark.createDataFrame([(1,)], "a int")
    add = stage.Stage("add", lambda t: {"d": t["d"].withColumn("b", t["d"]["a"] + 1)}, {"d": ["a"]}, {"d": ["b"]})
    use = stage.Stage("use", lambda t: {"d": t["d"].withColumn("c", t["d"]["b"] * 2)}, {"d": ["b", "z"]}, {"d": ["c"]})
    assert stage.needed([add, use]) == {"d": ["a", "z"]}
    with pytest.raises(ValueError, match="use needs"):
        stage.run_stages([add, use], {"d": base})
    assert stage.run_stages([add], {"d": base})["d"].first()["b"] == 2
