from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from touchline.sources import readers, writers


def labels(tmp_path, name="a"):
    box = {"x_bottom_left": 0.0, "y_bottom_left": 0.0, "x_bottom_middle": 1.0, "y_bottom_middle": 2.0, "x_bottom_right": 2.0, "y_bottom_right": 0.0}
    doc = {
        "info": {"id": "1", "name": name, "version": "1.3"},
        "images": [{"image_id": "1000", "file_name": "000007.jpg"}],
        "annotations": [
            {"id": "5", "image_id": "1000", "track_id": 3, "supercategory": "object", "bbox_image": {"x": 1.0, "y": 2.0, "w": 3.0, "h": 4.0}, "bbox_pitch": box, "attributes": {"role": "player", "team": "left", "jersey": "10"}},
            {"id": "6", "image_id": "1000", "track_id": None, "supercategory": "object", "bbox_pitch": box, "attributes": {"team": "right", "jersey": ""}},
            {"id": "7", "image_id": "12", "track_id": 1, "supercategory": "object", "bbox_pitch": box, "attributes": {}},
            {"id": "8", "image_id": "1000", "supercategory": "pitch", "bbox_pitch": None},
        ],
        "categories": [],
    }
    (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    return str(tmp_path / f"{name}.json")


def test_positions_of_label_files(spark, tmp_path):
    doc = readers.labels(spark, labels(tmp_path))
    got = {r["track_id"]: (r["frame"], r["role"], r["jersey_number"], r["x"]) for r in readers.positions(doc).collect()}
    assert got == {3: (7, "player", 10, 1.0), 6: (7, "other", None, 1.0), 1: (12, "other", None, 1.0)}
    objects, others = readers.flattened_annotations(doc)
    assert objects.count() == 3 and others.count() == 1
    assert objects.where("track_id = 3").first()["team_cluster"] == 1.0


def test_tracking_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1,2,11,21,5,6,0.9,1,1\n\n2 2 12 22 5 6 0.1 1 1\n")
    got = readers.tracks(spark, str(tmp_path / "m.txt"), "mot", min_confidence=0.5).collect()
    assert [(r["frame"], r["id"], r["x"], r["y"]) for r in got] == [(1, 2, 10.0, 20.0)]
    (tmp_path / "v.txt").write_text('0 10 20 30 50 7 0 1 0 "Person" "Walk" "Run"\n1 0 0 5 5 8 0 0 0 "Person"\n')
    v = {r["id"]: r for r in readers.tracks(spark, str(tmp_path / "v.txt"), "vatic").collect()}
    assert (v[0]["w"], v[0]["h"], v[0]["Walk"], v[1]["Walk"]) == (20.0, 30.0, True, False)
    xml = '<sequence><frame num="3"><target_list><target id="9"><box left="1.5" top="2" width="3" height="4"/></target></target_list></frame></sequence>'
    (tmp_path / "d.xml").write_text(xml)
    d = readers.tracks(spark, str(tmp_path / "d.xml"), "detrac").first()
    assert (d["frame"], d["id"], d["x"]) == (3, 9, 1.5)
    with pytest.raises(ValueError, match="unknown format"):
        readers.tracks(spark, "x", "other")


def test_csv_sources(spark, tmp_path):
    (tmp_path / "i.csv").write_text('id,cues,other,why\na,"- one\n- two",b,x\na,three,,\n', encoding="utf-8-sig")
    g = readers.glossary(spark, str(tmp_path / "i.csv"), "id", ["cues"], [("other", "why")]).first()
    assert g["cues"] == ["three"] and g["confusable"] == []
    with pytest.raises(ValueError, match="missing columns"):
        readers.all_string_csv(spark, str(tmp_path / "i.csv"), ["nope"])


def test_state_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "state")
    a = spark.createDataFrame([("v1", 1), ("v2", 2)], "video_id string, x long")
    assert writers.append_state(a, path) == 2
    assert writers.append_state(a.unionByName(spark.createDataFrame([("v3", 3)], a.schema)), path) == 1
    assert sorted(r["x"] for r in readers.state(spark, path, ["v1", "v3"], ["x"]).collect()) == [1, 3]


def test_exports(spark, tmp_path):
    d = spark.createDataFrame([("v", "i0", 1, [1.0, 2.0, 3.0, 4.0], 0.5, None, "player", "left", "7"), ("v", "i0", 2, None, 0.5, None, "ball", None, None)],
        "video_id string, image_id string, track_id long, bbox_ltwh array<double>, bbox_conf double, bbox_pitch struct<x_bottom_middle: double, y_bottom_middle: double>, role string, team string, jersey_number string")
    images = spark.createDataFrame([("i0", "v", 0)], "image_id string, video_id string, frame long")
    m = writers.mot_rows(d, images).collect()
    assert [(r["frame"], r["id"], r["bb_width"], r["z"]) for r in m] == [(1, 1, 3.0, -1)]
    h = lambda ok: spark.createDataFrame([("i0", ok)], "image_id string, valid boolean")
    assert writers.label_annotations(d, h(False)).count() == 1 and writers.label_annotations(d, h(True)).count() == 0
    writers.write_label_json(writers.label_annotations(d, h(False)), str(tmp_path / "o"))
    assert json.loads(spark.read.text(str(tmp_path / "o")).first()["value"])["attributes"]["jersey"] == "7"


def test_refined_state(spark):
    rows = spark.createDataFrame([("v", 1, 5), ("v", 2, 6), ("w", 3, 7)], "video string, det long, track_id long")
    matched = spark.createDataFrame([("v", 1, 50)], "video string, det long, new_track_id long")
    added = spark.createDataFrame([("v", 9, 90)], "video string, det long, track_id long")
    assert sorted(map(tuple, writers.refined(rows, matched, added, "det", "video").collect())) == [("v", 1, 50), ("v", 9, 90), ("w", 3, 7)]


def test_small_rules(spark):
    df = spark.createDataFrame([(23, 0.9), (7, 0.9), (7, 0.2), (140, 0.9)], "j int, s double")
    got = [r["v"] for r in df.select(readers.legible_jersey(F.col("j"), F.col("s")).alias("v")).collect()]
    assert [tuple(v) if v else None for v in got] == [(2, 3), (None, 7), None, None]
    style = spark.createDataFrame([({"r": 300.0, "zz": 1.0},)], "o map<string, double>").select(readers.with_defaults(F.col("o"), {"r": 1, "g": 2}, 0.0, 255.0).alias("m")).first()["m"]
    assert style == {"r": 255.0, "g": 2.0}
    files = readers.numbered_frames(spark, "v", 2).collect()
    assert [r["image_id"] for r in files] == ["000001", "000002"]
