"""Queries of cameras and reports, and round trips of readers and writers, with their SQL.

A round trip writes rows of the given tables in a format, to a new folder below the one that the
session shares, and reads them back; its SQL says what must come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import cameras, geometry
from .queries import _r, _read, query
from .session import scratch
from .sources import readers, reports, versions, writers


def _matrix(*rows) -> F.Column:
    return F.array(*(F.array(*(F.lit(float(v)) if isinstance(v, int | float) else v for v in row)) for row in rows))


#: A camera eight metres above the ground that looks along y.
_K, _R = ((1000, 0, 960), (0, 1000, 540), (0, 0, 1)), ((1, 0, 0), (0, 0, -1), (0, 1, 0))


@query("""
WITH e AS (SELECT event_id, (value * 20 - 960) / 1000 AS rx, (user_id % 7 - 3) / 10.0 AS ry FROM events)
SELECT event_id, CASE WHEN ry <> 0 THEN round_even(5 + 8 / ry * rx, 6) END AS x, CASE WHEN ry <> 0 THEN round_even(-30 + 8 / ry, 6) END AS y FROM e""")
def ground_points(spark, sf_dir):
    """Image points on the ground from K, R and the camera's place; rays along the ground have none."""
    at = F.array(*(F.lit(v) for v in (5.0, -30.0, 8.0)))
    rows = _read(spark, sf_dir, "events").withColumn("p", cameras.ground_point(_matrix(*_K), _matrix(*_R), at, F.col("value") * 20, 540.0 + (F.col("user_id") % 7 - 3) * 100))
    return rows.select("event_id", _r(F.col("p.x")).alias("x"), _r(F.col("p.y")).alias("y"))


@query("""
WITH l AS (SELECT event_id, value - 50 AS x1, (event_id % 13) * 8.0 - 45 AS d1, user_id % 90 - 45 AS x2, (event_id % 7) * 20.0 - 40 AS d2 FROM events),
c AS (SELECT event_id, CASE WHEN d1 <= 0.1 THEN x1 + (0.1 - d1) / (d2 - d1) * (x2 - x1) ELSE x1 END AS x1, greatest(d1, 0.1) AS d1, CASE WHEN d2 <= 0.1 THEN x1 + (0.1 - d1) / (d2 - d1) * (x2 - x1) ELSE x2 END AS x2, greatest(d2, 0.1) AS d2 FROM l WHERE d1 > 0.1 OR d2 > 0.1),
s AS (SELECT event_id, (1000 * x1 / d1 + 960) / 1920 AS x1, (8000 / d1 + 540) / 1080 AS y1, (1000 * x2 / d2 + 960) / 1920 AS x2, (8000 / d2 + 540) / 1080 AS y2 FROM c),
d AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM s),
t AS (SELECT *, greatest(0, CASE WHEN dx > 0 THEN -x1 / dx WHEN dx < 0 THEN (1 - x1) / dx ELSE 0 END, CASE WHEN dy > 0 THEN -y1 / dy WHEN dy < 0 THEN (1 - y1) / dy ELSE 0 END) AS a,
 least(1, CASE WHEN dx > 0 THEN (1 - x1) / dx WHEN dx < 0 THEN -x1 / dx ELSE 1 END, CASE WHEN dy > 0 THEN (1 - y1) / dy WHEN dy < 0 THEN -y1 / dy ELSE 1 END) AS b,
 (dx = 0 AND (x1 < 0 OR x1 > 1)) OR (dy = 0 AND (y1 < 0 OR y1 > 1)) AS out FROM d),
v AS (SELECT event_id, x1 + a * dx AS x1, y1 + a * dy AS y1, x1 + b * dx AS x2, y1 + b * dy AS y2 FROM t WHERE NOT out AND a <= b)
SELECT e.event_id, v.event_id IS NOT NULL AS seen, round_even(x1, 6) + 0 AS x1, round_even(y1, 6) + 0 AS y1, round_even(x2, 6) + 0 AS x2, round_even(y2, 6) + 0 AS y2 FROM events e LEFT JOIN v USING (event_id)""")
def lines_visible(spark, sf_dir):
    """Lines on the ground as an image of 1920 by 1080 shows them; what lies behind the camera is cut off."""
    rt = _matrix((1, 0, 0, 0), (0, 0, -1, 8), (0, 1, 0, 0))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(0.0).alias("z"))
    a = point(F.col("value") - 50, (F.col("event_id") % 13) * 8.0 - 45)
    b = point(F.col("user_id") % 90 - 45, (F.col("event_id") % 7) * 20.0 - 40)
    rows = _read(spark, sf_dir, "events").withColumn("l", cameras.visible_line(_matrix(*_K), rt, a, b, F.lit(1920.0), F.lit(1080.0)))
    return rows.select("event_id", F.col("l").isNotNull().alias("seen"), *((_r(F.col("l")[c]) + 0.0).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("""
WITH c AS (SELECT c_nationkey, c_custkey, round(c_acctbal) AS b FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 5)
SELECT c_nationkey, concat('| c_custkey | balance |', chr(10), '|---|---|', chr(10), string_agg(concat('| ', c_custkey, ' | ', CAST(b AS BIGINT), ' |'), chr(10) ORDER BY c_custkey)) AS text FROM c GROUP BY c_nationkey""")
def report_tables(spark, sf_dir):
    """A table of text for each nation, of its five customers of largest balance."""
    from .operators import ranking

    best = ranking.top_k(_read(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5)
    return reports.markdown(best.withColumn("balance", F.round("c_acctbal").cast("long")), ["c_custkey", "balance"], ["c_custkey"], ["c_nationkey"])


@query("""
WITH l AS (SELECT l_orderkey // 64 AS clip, l_orderkey % 64 AS w, l_linenumber % 3 AS line, l_quantity AS x, l_suppkey, l_orderkey FROM lineitem),
r AS (SELECT clip, w, line, round_even(sum(x) / count(*), 1) AS x, count(*) AS n, max(l_suppkey) % 4 AS s, w % 2 AS side FROM l GROUP BY ALL),
p AS (SELECT clip, w, side, max(CASE WHEN line = 0 AND s > 0 THEN concat('forward[left]=x', x, 'm/span', CAST(n AS DOUBLE), 'm') END) AS a, max(CASE WHEN line = 1 AND s > 0 THEN concat('midfield[left]=x', x, 'm/span', CAST(n AS DOUBLE), 'm') END) AS b,
  max(CASE WHEN line = 2 AND s > 0 THEN concat('last_line[right]=x', x, 'm/span', CAST(n AS DOUBLE), 'm') END) AS c, max(CASE WHEN s = 0 THEN 'unstable' END) AS g FROM r GROUP BY ALL),
t AS (SELECT clip, w, concat_ws(' ', format('t={:.1f}s', w * 0.5), CASE WHEN side = 1 THEN 'attack=left' END, a, b, c, CASE WHEN w % 5 = 0 THEN concat('gap=', CAST(w AS DOUBLE), 'm') END,
  CASE WHEN w % 3 = 0 THEN concat('ball=x', CAST(w AS DOUBLE), 'm/y1.5m/move0.0m') END, CASE WHEN g IS NOT NULL THEN 'gaps=unstable' END) AS line FROM p)
SELECT clip, concat('position_source=rows', chr(10), string_agg(line, chr(10) ORDER BY w)) AS text FROM t GROUP BY clip
UNION ALL SELECT -1, concat('position_source=', chr(10), 'no renderable topology windows (insufficient ball/goalkeeper/possession evidence)')""")
def digests_rendered(spark, sf_dir):
    """One line of text for each window of a block of orders; a clip without windows says so."""
    rows = _read(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 64").alias("clip"), (F.col("l_orderkey") % 64).alias("window"), (F.col("l_linenumber") % 3).alias("k"), "l_quantity", "l_suppkey")
    team = F.when(F.col("k") == 2, "right").otherwise("left")
    line = F.get(F.array(*(F.lit(v) for v in reports.LINES.values())), F.col("k"))
    per = rows.groupBy("clip", "window", "k").agg(F.collect_list(F.struct(F.col("l_quantity").alias("x_m"))).alias("members"), (F.max("l_suppkey") % 4).alias("s"), F.count("*").cast("double").alias("lateral_span_m"))
    gaps = F.when(F.col("s") == 0, F.array(F.lit("unstable"))).otherwise(F.array().cast("array<string>"))
    found = per.select(
        "clip", "window", F.when(F.col("window") % 2 == 1, "left").alias("attacking_team"), line.alias("line"), team.alias("team"), F.when(F.col("s") > 0, "renderable").otherwise("candidate").alias("status"),
        "members", "lateral_span_m", gaps.alias("evidence_gaps"),
    )
    w = F.col("window").cast("double")
    each = found.select("clip", "window").distinct()
    zones = each.where("window % 5 = 0").select("clip", "window", F.lit("inter_line_space").alias("type"), F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(1.0 + w, F.lit(0.0))).alias("polygon"))
    balls = each.where("window % 3 = 0").select("clip", "window", w.alias("x_m"), F.lit(1.5).alias("y_m"), F.lit(0.0).alias("displacement_m"))
    clips = each.select("clip", F.lit("rows").alias("position_source")).distinct()
    none = spark.range(1).select((F.col("id") - 1).alias("clip"), F.lit(None).cast("string").alias("position_source"))
    return reports.digest_text(reports.digest_rows(found, zones, balls), clips.unionByName(none))


# Round trips


@query("SELECT o_orderkey, o_custkey, 2 AS version FROM orders UNION ALL SELECT c_custkey, c_nationkey, 2 FROM customer")
def versions_promoted(spark, sf_dir):
    """Two versions of two tables, the second one goes on after a failure; what counts is the second, whole."""
    v = versions.Versions(spark, scratch(spark))
    orders, customers = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    tables = lambda n: {"orders": orders.withColumn("version", F.lit(n)), "customers": customers.withColumn("version", F.lit(n))}
    v.promote("first", tables(1))
    try:
        v.promote("second", tables(2), checks={"customers": lambda df: ["not yet"]}, keep=True)
    except ValueError:
        v.promote("second", tables(2))
    return v.read("orders").unionByName(v.read("customers").toDF("o_orderkey", "o_custkey", "version"))


@query("""
WITH e AS (SELECT event_id, user_id // 40 AS video, event_id // 7 AS frame, user_id, value FROM events), m AS (SELECT video, min(frame) AS first FROM e WHERE user_id % 9 > 0 GROUP BY video)
SELECT CAST(frame + (first = 0)::INT AS BIGINT) AS frame, user_id AS id, round_even(value - 1, 4) AS x, round_even(user_id / 2 - 1, 4) AS y, 20.0::DOUBLE AS w, 40.5::DOUBLE AS h, round_even(value / 100, 4) AS confidence FROM e JOIN m USING (video) WHERE user_id % 9 > 0""")
def mot_round_trip(spark, sf_dir):
    """Tracks as text by video and back; rows without a track go, frames and corners are shifted."""
    e = _read(spark, sf_dir, "events").withColumn("video_id", F.expr("cast(user_id div 40 as string)")).withColumn("frame", F.expr("event_id div 7"))
    image = F.concat_ws("-", "video_id", "frame").alias("image_id")
    detections = e.select(
        "video_id", image, F.when(F.col("user_id") % 9 > 0, F.col("user_id")).alias("track_id"),
        F.array(F.col("value"), F.col("user_id") / 2, F.lit(20.0), F.lit(40.5)).alias("bbox_ltwh"), (F.col("value") / 100).alias("bbox_conf"),
    )
    path = scratch(spark)
    writers.write_mot(writers.mot_rows(detections, e.select("video_id", image, "frame").distinct()), path)
    back = readers.tracks(spark, path, "mot")
    return back.select("frame", "id", _r("x", 4).alias("x"), _r("y", 4).alias("y"), "w", "h", _r("confidence", 4).alias("confidence"))


@query("""
SELECT concat('b', l_orderkey // 512) AS clip, CASE WHEN l_linenumber % 5 > 0 THEN l_suppkey ELSE l_partkey END AS track_id, CASE l_linenumber % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS team, CASE WHEN l_linenumber % 4 > 0 THEN 'player' ELSE 'other' END AS role,
  CASE WHEN l_suppkey % 6 > 0 THEN CAST(l_suppkey % 30 AS INTEGER) END AS jersey_number, l_quantity AS x, l_tax AS y, l_orderkey % 512 AS frame FROM lineitem WHERE l_partkey % 7 > 0""")
def labels_round_trip(spark, sf_dir):
    """Label documents of blocks of orders, written as JSON and read as positions."""
    rows = _read(spark, sf_dir, "lineitem").withColumn("clip", F.concat(F.lit("b"), F.expr("l_orderkey div 512"))).withColumn("image_id", F.concat(F.lit("i"), F.col("l_orderkey").cast("string")))
    k = F.col("l_linenumber")
    box = F.struct(F.when(F.col("l_partkey") % 7 > 0, F.col("l_quantity")).alias("x_bottom_middle"), F.col("l_tax").alias("y_bottom_middle"))
    attributes = F.struct(
        F.when(k % 4 > 0, "player").alias("role"), F.when(k % 3 == 0, "left").when(k % 3 == 1, "right").alias("team"), F.when(F.col("l_suppkey") % 6 > 0, (F.col("l_suppkey") % 30).cast("string")).otherwise("").alias("jersey"),
    )
    a = F.struct(F.col("l_partkey").cast("string").alias("id"), "image_id", F.when(k % 5 > 0, F.col("l_suppkey")).alias("track_id"), F.lit("object").alias("supercategory"), box.alias("bbox_pitch"), attributes.alias("attributes"))
    image = F.struct("image_id", F.format_string("img1/%06d.jpg", F.col("l_orderkey") % 512).alias("file_name"))
    doc = rows.groupBy("clip").agg(F.struct(F.first("clip").alias("name")).alias("info"), F.collect_set(image).alias("images"), F.collect_list(a).alias("annotations"))
    path = scratch(spark)
    doc.select("clip", F.to_json(F.struct("info", "images", "annotations"), {"ignoreNullFields": "true"}).alias("value")).repartition("clip").write.partitionBy("clip").text(path, compression="gzip")
    found = readers.labels(spark, path).drop("clip")
    return readers.positions(found).select("clip", "track_id", "team", "role", "jersey_number", "x", "y", "frame")


@query("SELECT concat('v', user_id % 23) AS video_id, event_id, value FROM events WHERE user_id % 23 IN (3, 4, 20)")
def state_round_trip(spark, sf_dir):
    """Videos are appended once, though they come again; some videos and columns are read."""
    e = _read(spark, sf_dir, "events").withColumn("video_id", F.concat(F.lit("v"), (F.col("user_id") % 23).cast("string")))
    path = scratch(spark)
    writers.append_state(e.where("user_id % 23 < 12"), path)
    writers.append_state(e.withColumn("value", F.when(F.col("user_id") % 23 < 12, -1.0).otherwise(F.col("value"))), path)
    return readers.state(spark, path, ["v3", "v4", "v20"], ["video_id", "event_id", "value"])


@query("""
SELECT CAST(l_linenumber AS INTEGER) AS class_id, l_orderkey AS t, count(*) AS n, min(l_partkey) AS first, string_agg(concat(l_suppkey, ' ', CAST(l_quantity AS BIGINT)), ';' ORDER BY l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS masks FROM lineitem GROUP BY ALL""")
def masks_round_trip(spark, sf_dir):
    """Masks of a timestep and class as text and back, in order of id."""
    rle = F.concat_ws(":", F.col("l_suppkey"), F.col("l_quantity").cast("long"))
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("t"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("class_id"), F.lit(12).alias("h"), F.lit(10).alias("w"), rle.alias("rle"), "l_suppkey", "l_quantity")
    path = scratch(spark)
    writers.write_rle(rows.select("t", "id", "class_id", "h", "w", "rle").withColumn("class_id", F.col("class_id")), path)
    schema = "t long, id long, class_id int, h int, w int, rle string"
    back = spark.read.csv(path, schema=schema, sep=" ").withColumn("score", F.lit(None).cast("double"))
    again = scratch(spark)
    back.select("t", "id", "class_id", "score", "h", "w", "rle").write.csv(again, sep=" ")
    found = readers.rle_sequence(spark, again)
    ids = F.transform("masks", lambda m: F.struct(m["id"].alias("id"), F.split(m["rle"], ":")[0].cast("long").alias("s"), F.split(m["rle"], ":")[1].cast("long").alias("q")))
    text = F.array_join(F.transform(F.sort_array(ids), lambda m: F.concat_ws(" ", m["s"], m["q"])), ";")
    return found.select("class_id", "t", F.size("masks").cast("long").alias("n"), F.col("masks")[0]["id"].alias("first"), text.alias("masks"))


@query("""
SELECT concat('i', event_id) AS image_id, user_id % 5 > 0 AS valid, CASE WHEN user_id % 5 > 0 THEN round_even(100 / (value + 1), 6) END AS x, CASE WHEN user_id % 5 > 0 THEN 50.0::DOUBLE END AS y FROM events""")
def homographies_round_trip(spark, sf_dir):
    """Cameras of images as JSON and back, and a point under those that are valid."""
    h = _matrix((F.col("value") + 1, 0, 0), (0, 2, 0), (0, 0, 1))
    rows = _read(spark, sf_dir, "events").select((F.col("event_id") % 8).alias("part"), F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("image_id"), h.alias("H"), (F.col("user_id") % 5 > 0).alias("valid"))
    rows = rows.withColumn("H_inv", F.when(F.col("valid"), geometry.inverse(F.col("H"))))
    path = scratch(spark)
    bodies = rows.withColumn("part", F.expr("cast(substring(image_id, 2) as bigint) div 1000")).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("image_id", F.struct("H", "H_inv", "valid")))).alias("m"))
    bodies.select("part", F.to_json("m").alias("value")).repartition("part").write.partitionBy("part").text(path)
    back = readers.homographies(spark, path)
    p = geometry.project(F.col("h_inverse"), F.lit(100.0), F.lit(100.0))
    return back.select("image_id", "valid", _r(p["x"]).alias("x"), _r(p["y"]).alias("y"))


@query("""
SELECT p_partkey, p_name, p_size FROM part""")
def json_lines_round_trip(spark, sf_dir):
    """One object a line, blank lines between them."""
    rows = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    path = scratch(spark)
    rows.select(F.concat(F.to_json(F.struct("p_partkey", "p_name", "p_size")), F.when(F.col("p_partkey") % 3 == 0, "\n\n").otherwise("")).alias("value")).write.text(path)
    return readers.jsonl(spark, path, rows.schema)


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, concat(p_name, ', \"', p_brand, '\"', chr(10), p_type) AS note FROM part")
def csv_round_trip(spark, sf_dir):
    """Evidence as CSV with quotes and line ends, read as strings."""
    note = F.concat(F.col("p_name"), F.lit(', "'), F.col("p_brand"), F.lit('"\n'), F.col("p_type"))
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lit("x").alias("more"), note.alias("note"))
    path = scratch(spark)
    reports.write_csv(rows, path)
    return readers.all_string_csv(spark, path, ["key", "note"])


@query("""
SELECT o_orderkey AS id, o_custkey % 300 AS frame, CAST(o_custkey % 40 AS DOUBLE) AS x, 10.0::DOUBLE AS w, o_orderkey % 2 = 1 AS lost, o_orderpriority AS label, o_orderkey % 3 = 0 AS "Running", o_orderkey % 4 = 0 AS "Walking" FROM orders""")
def vatic_round_trip(spark, sf_dir):
    """Tracks with activities at the end of the line."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    acts = F.concat_ws(" ", F.when(k % 3 == 0, '"Running"'), F.when(k % 4 == 0, '"Walking"'))
    label = F.concat(F.lit('"'), F.regexp_replace("o_orderpriority", " ", "_"), F.lit('"'))
    line = F.concat_ws(" ", k, c % 40, c % 50, c % 40 + 10, c % 50 + 20, c % 300, k % 2, F.lit(0), F.lit(1), label, acts)
    path = scratch(spark)
    _read(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    back = readers.tracks(spark, path, "vatic")
    return back.select("id", "frame", "x", "w", "lost", F.regexp_replace("label", "_", " ").alias("label"), "Running", "Walking")


@query("SELECT o_custkey AS frame, o_orderkey AS id, round_even(o_totalprice, 2) AS x, 5.0::DOUBLE AS h FROM orders")
def xml_round_trip(spark, sf_dir):
    """Frames with target boxes in XML."""
    box = F.struct(F.bround("o_totalprice", 2).alias("_left"), F.lit(1.0).alias("_top"), F.lit(3.0).alias("_width"), F.lit(5.0).alias("_height"))
    target = F.struct(F.col("o_orderkey").alias("_id"), box.alias("box"))
    rows = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("_num")).agg(F.collect_list(target).alias("target")).select("_num", F.struct("target").alias("target_list"))
    path = scratch(spark)
    rows.write.format("xml").option("rowTag", "frame").option("rootTag", "sequence").save(path)
    return readers.tracks(spark, path, "detrac").select("frame", "id", "x", "h")


@query("""
SELECT concat('v', l_orderkey // 256) AS video_id, l_suppkey AS track_id, CASE WHEN l_suppkey % 3 > 0 THEN l_quantity END AS x, CASE WHEN l_linenumber % 2 = 0 THEN round_even(l_tax, 4) END AS foot, CAST(l_linenumber AS VARCHAR) AS jersey
FROM lineitem WHERE l_linenumber % 2 = 0 OR (l_suppkey % 3 > 0 AND l_orderkey % 4 = 0)""")
def label_json_round_trip(spark, sf_dir):
    """Annotations to export as JSON by video: with a pitch box, or with an image box where the camera is invalid."""
    rows = _read(spark, sf_dir, "lineitem")
    nan = F.lit(float("nan"))
    box = F.array("l_quantity", F.lit(1.0), F.lit(2.0), F.lit(3.0))
    foot = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")).otherwise(nan)
    pitch = F.struct(*(F.lit(0.0).alias(f"{c}_bottom_{k}") if k != "middle" else foot.alias(f"{c}_bottom_middle") for k in ("left", "middle", "right") for c in ("x", "y")))
    detections = rows.select(
        F.concat(F.lit("v"), F.expr("l_orderkey div 256")).alias("video_id"), F.col("l_orderkey").alias("image_id"), F.col("l_suppkey").alias("track_id"), F.when(F.col("l_suppkey") % 3 > 0, box).alias("bbox_ltwh"),
        pitch.alias("bbox_pitch"), F.lit("player").alias("role"), F.lit("left").alias("team"), F.col("l_linenumber").alias("jersey_number"),
    )
    cams = rows.select(F.col("l_orderkey").alias("image_id"), (F.col("l_orderkey") % 4 > 0).alias("valid")).distinct()
    path = scratch(spark)
    writers.write_label_json(writers.label_annotations(detections, cams), path)
    schema = "video_id string, track_id bigint, bbox_image struct<x: double>, bbox_pitch struct<x_bottom_middle: double>, attributes struct<jersey: string>"
    back = spark.read.schema(schema).json(path)
    return back.select("video_id", "track_id", F.col("bbox_image.x").alias("x"), _r("bbox_pitch.x_bottom_middle", 4).alias("foot"), F.col("attributes.jersey").alias("jersey"))


@query("""
SELECT user_id, CAST(round_even(sum(value) FILTER (event_type = 'click'), 4) AS VARCHAR) AS click, CAST(round_even(sum(value) FILTER (event_type = 'view'), 4) AS VARCHAR) AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id""")
def summary_round_trip(spark, sf_dir):
    """One column for each metric, and back as strings."""
    per = _read(spark, sf_dir, "events").where("event_type in ('click', 'view')").groupBy("user_id", "event_type").agg(_r(F.sum("value"), 4).alias("value"))
    path = scratch(spark)
    writers.write_wide_summary(per, ["user_id"], "event_type", "value", path)
    back = readers.all_string_csv(spark, path, ["user_id", "click", "view"])
    return back.select(F.col("user_id").cast("long").alias("user_id"), "click", "view")


def _listed(df: DataFrame) -> DataFrame:
    return df.select(F.regexp_extract("path", r"name=([^/]+)/", 1).alias("name"), "length", "sha256")


@query("SELECT concat('n', n_nationkey) AS name, CAST(strlen(n_name) + 1 AS BIGINT) AS length, sha256(concat(n_name, chr(10))) AS sha256 FROM nation")
def files_listed(spark, sf_dir):
    """Files below a folder with their sizes and digests of their contents."""
    path = scratch(spark)
    rows = _read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("value"))
    rows.write.partitionBy("name").text(path)
    return _listed(readers.files(spark, path, "*.txt", digest=True))


@query("""
WITH e AS (SELECT event_id, user_id // 20 AS v, event_id // 300 AS i, value, CASE WHEN value > 20 THEN value * 2 + 1 END AS y FROM events),
r AS (SELECT *, CASE WHEN y IS NOT NULL THEN row_number() OVER (PARTITION BY v, i ORDER BY y NULLS LAST, event_id) END AS place FROM e)
SELECT event_id, round_even(y, 4) AS y, CAST(place AS BIGINT) AS place, count(y) OVER (PARTITION BY v) AS seen FROM r""")
def stages_merged(spark, sf_dir):
    """A stage of rows, one of images and one of videos, each merged into the detections."""
    from .plans import stage

    e = _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("det_id"), F.expr("user_id div 20").alias("video_id"), F.concat_ws("-", F.expr("user_id div 20"), F.expr("event_id div 300")).alias("image_id"), "value"
    )

    def placed(rows):
        some = rows[rows["y"].notna()].sort_values(["y", "det_id"])
        return rows.assign(place=(some.groupby("image_id").cumcount() + 1).astype("Int64").reindex(rows.index))

    stages = [
        stage.detections_stage("y", lambda b: b.assign(y=b["value"] * 2 + 1), ["value"], {"y": "double"}, where=F.col("value") > 20),
        stage.images_stage("place", placed, ["y"], {"place": "bigint"}, many=True),
        stage.videos_stage("seen", lambda t: t.join(t.groupBy("video_id").agg(F.count("y").alias("seen")), "video_id"), ["y"], {"seen": "bigint"}),
    ]
    out = stage.run_stages(stages, {"detections": e})["detections"]
    return out.select(F.col("det_id").alias("event_id"), _r("y", 4).alias("y"), "place", "seen")


@query("""
SELECT l_orderkey AS frame, coalesce(string_agg(concat(l_linenumber, ':', l_suppkey), ' ' ORDER BY l_partkey, l_linenumber, l_suppkey) FILTER (l_linenumber % 3 > 0), '') AS annotations FROM lineitem GROUP BY l_orderkey""")
def predictions_indexed(spark, sf_dir):
    """The annotations of each frame in their stored order; frames without any have an empty list."""
    rows = _read(spark, sf_dir, "lineitem")
    images = rows.select(F.col("l_orderkey").alias("image_id"), F.format_string("img1/%08d.jpg", "l_orderkey").alias("file_name")).distinct()
    annotations = rows.where("l_linenumber % 3 > 0").select(F.col("l_orderkey").alias("image_id"), F.struct("l_partkey", "l_linenumber", "l_suppkey").alias("pos"), "l_linenumber", "l_suppkey")
    found = readers.predictions_index(images, annotations)
    return found.select("frame", F.array_join(F.transform("annotations", lambda a: F.concat_ws(":", a["l_linenumber"], a["l_suppkey"])), " ").alias("annotations"))


@query("""
WITH r AS (SELECT concat('v', o_custkey // 100) AS video_id, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS track_id, NULL::VARCHAR AS kind FROM orders
  UNION ALL SELECT concat('v', c_custkey // 100), concat('c', c_custkey), NULL, c_mktsegment FROM customer)
SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY id) - 1 AS INTEGER) AS place, id, track_id, kind FROM r""")
def documents_round_trip(spark, sf_dir):
    """One document for each video of rows of two kinds, sorted by id as text, written and read."""
    rows = _read(spark, sf_dir, "orders").select(F.concat(F.lit("v"), F.expr("o_custkey div 100")).alias("video_id"), F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("track_id"))
    more = _read(spark, sf_dir, "customer").select(F.concat(F.lit("v"), F.expr("c_custkey div 100")).alias("video_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_mktsegment").alias("kind"))
    path = scratch(spark)
    writers.write_evaluation_documents(writers.evaluation_documents(rows, more), path)
    schema = "video_id string, predictions array<struct<id: string, track_id: bigint, kind: string>>"
    back = spark.read.schema(schema).json(path)
    return back.select("video_id", F.posexplode("predictions").alias("place", "p")).select("video_id", "place", "p.*")


@query("""
SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS tracker, CAST(user_id AS VARCHAR) AS seq, event_type AS field, round_even(max(value), 4) AS value FROM events
WHERE user_id % 2 = 0 OR event_type IN ('click', 'view') GROUP BY ALL""")
def details_round_trip(spark, sf_dir):
    """Wide results of two trackers, with different metrics, read as one long table."""
    per = _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("seq"), "event_type").agg(_r(F.max("value"), 4).alias("value"))
    paths = {"even": scratch(spark), "odd": scratch(spark)}
    writers.write_wide_summary(per.where("seq % 2 = 0"), ["seq"], "event_type", "value", paths["even"])
    writers.write_wide_summary(per.where("seq % 2 = 1 and event_type in ('click', 'view')"), ["seq"], "event_type", "value", paths["odd"])
    return readers.metric_details(spark, paths)
