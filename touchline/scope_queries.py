"""Queries of gates, ignore regions, distractors, look-ups and projections, with their SQL.

An event stands for a detection, a reply or a segment's row, a line of an order for a skeleton of
three points; every query works on whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .evaluation import tracking
from .functions import geometry
from .operators import claims, integrity, merge, preparation
from .queries import _r, _read, query


@query("SELECT event_id, value FROM events WHERE value > 50")
def scores_above(spark, sf_dir):
    """F04, F24."""
    return preparation.above(_read(spark, sf_dir, "events"), "value", 50.0).select("event_id", "value")


def _points(*pairs):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pairs))


@query("""
WITH e AS (SELECT event_id, user_id % 4 AS image, value AS l, (user_id % 20) * 5.0 AS t FROM events),
o AS (SELECT *, greatest(0, least(l + 30, 60) - greatest(l, 20)) * greatest(0, least(t + 30, 100) - t) + greatest(0, least(l + 30, 100) - greatest(l, 60)) * greatest(0, least(t + 30, 40) - t) AS bent,
 greatest(0, least(l + 30, 15) - greatest(l, 0)) * greatest(0, least(t + 30, 150) - t) AS band FROM e)
SELECT event_id, (image IN (0, 1) AND bent > 0.4037 * 900) OR (image = 1 AND band > 0.4037 * 900) AS ignored FROM o""")
def ignored_boxes(spark, sf_dir):
    """Boxes inside ignore regions, one of them with a reflex corner."""
    corner = F.array(F.col("value"), (F.col("user_id") % 20) * 5.0, F.col("value") + 30, (F.col("user_id") % 20) * 5.0 + 30)
    rows = _read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("image"), corner.alias("box"))
    bent, band = _points((20, 0), (100, 0), (100, 40), (60, 40), (60, 100), (20, 100)), _points((0, 0), (15, 0), (15, 150), (0, 150))
    images = spark.range(2).select(F.col("id").alias("image"))
    regions = images.select("image", bent.alias("polygon")).unionByName(images.where("image = 1").select("image", band.alias("polygon")))
    return preparation.ignored(rows, regions, "image", "box", 0.4037).select("event_id", "ignored")


@query("""
SELECT event_id // 5 AS frame, event_id AS pred_id FROM events
WHERE event_id % 3 <> 0 AND NOT ((event_type = 'error' OR value < 5) AND (event_id % 7) * 2 <= 6)""")
def distractors_removed(spark, sf_dir):
    """predictions that no distractor takes."""
    e = _read(spark, sf_dir, "events").withColumn("frame", F.expr("event_id div 5")).withColumn("l", (F.col("event_id") % 5) * 1000.0)
    box = lambda left: F.array(left, F.lit(0.0), left + 20, F.lit(40.0))
    truth = e.select("frame", F.col("event_id").alias("truth_id"), box(F.col("l")).alias("box"), ((F.col("event_type") == "error") | (F.col("value") < 5)).alias("distractor"))
    moved = F.col("l") + (F.col("event_id") % 7) * 2
    pred = e.where("event_id % 3 <> 0").select("frame", F.col("event_id").alias("pred_id"), box(moved).alias("box"))
    return preparation.without_distractors(pred, truth).select("frame", "pred_id")


@query("SELECT event_id FROM events WHERE value / 100 >= 0.5 AND user_id % 3 = 1")
def benchmark_rows(spark, sf_dir):
    """Truth rows that count."""
    e = _read(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("confidence"), (F.col("user_id") % 3).alias("kind"))
    return preparation.benchmark_truth(e, "confidence", "kind", least=0.5).select("event_id")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [{'x': l_quantity, 'y': l_tax * 100, 'c': l_discount}, {'x': l_quantity + 3, 'y': l_discount * 100 + 1, 'c': l_tax}, {'x': l_extendedprice / 1000, 'y': 5.0, 'c': l_linenumber - 2.0}] AS p FROM lineitem),
s AS (SELECT *, list_filter(p, lambda v: v.c > 0) AS s FROM p),
a AS (SELECT *, (list_max(list_transform(s, lambda v: v.x)) - list_min(list_transform(s, lambda v: v.x))) * (list_max(list_transform(s, lambda v: v.y)) - list_min(list_transform(s, lambda v: v.y))) AS area,
 (list_max(list_transform(p, lambda v: v.x)) - list_min(list_transform(p, lambda v: v.x))) * (list_max(list_transform(p, lambda v: v.y)) - list_min(list_transform(p, lambda v: v.y))) AS total,
 0.5 * (list_max(list_transform(s, lambda v: v.x - v.y)) - list_min(list_transform(s, lambda v: v.x - v.y))) * (list_max(list_transform(s, lambda v: v.x + v.y)) - list_min(list_transform(s, lambda v: v.x + v.y))) AS area45,
 0.5 * (list_max(list_transform(p, lambda v: v.x - v.y)) - list_min(list_transform(p, lambda v: v.x - v.y))) * (list_max(list_transform(p, lambda v: v.x + v.y)) - list_min(list_transform(p, lambda v: v.x + v.y))) AS total45 FROM s),
k AS (SELECT *, sqrt(area) * least(5.0, sqrt(coalesce(least(CASE WHEN area > 0.1 THEN total / area END, CASE WHEN area45 > 0.1 THEN total45 / area45 END), 25.0))) AS scale FROM a)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN len(s) > 0 AND scale >= 0.1 THEN round_even((CASE WHEN p[1].c > 0 THEN exp(-1.25 / (2 * scale * scale * 0.01)) ELSE 0 END
 + CASE WHEN p[2].c > 0 THEN exp(-1.25 / (2 * scale * scale * 0.04)) ELSE 0 END + CASE WHEN p[3].c > 0 THEN exp(-1.25 / (2 * scale * scale * 0.09)) ELSE 0 END) / len(s), 5) END AS similarity FROM k""")
def keypoint_similarities(spark, sf_dir):
    """Each skeleton against itself moved by one and a half."""
    point = lambda x, y, c: F.struct(x.alias("x"), y.alias("y"), c.alias("c"))
    q, d, t, price = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice") / 1000
    points = F.array(point(q, t * 100, d), point(q + 3, d * 100 + 1, t), point(price, F.lit(5.0), F.col("l_linenumber") - F.lit(2.0)))
    moved = F.transform("points", lambda p: F.struct((p["x"] + 1).alias("x"), (p["y"] + 0.5).alias("y"), p["c"].alias("c")))
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", points.alias("points"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _r(preparation.keypoint_similarity(F.col("points"), moved, [0.1, 0.2, 0.3]), 5).alias("similarity"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN round_even(value / (event_id % 3), 6) END AS rate FROM events")
def quiet_rates(spark, sf_dir):
    """Nothing where the divisor is 0."""
    return _read(spark, sf_dir, "events").select("event_id", _r(F.try_divide(F.col("value"), F.col("event_id") % 3)).alias("rate"))


@query("""
SELECT event_id, round_even(user_id + value, 6) AS l, round_even(3 + value / 2, 6) AS t, round_even(7 - value / 2, 6) AS w, round_even(9 - value, 6) AS h FROM events""")
def readings_placed(spark, sf_dir):
    """Corners in a crop to a box in the image."""
    v = F.col("value")
    corners = F.array(F.array(v, v / 2), F.array(v + 5, F.lit(7.0)), F.array(v + 5, v), F.array(F.lit(9.0), v))
    box = preparation.ocr_box(corners, F.array(F.col("user_id").cast("double"), F.lit(3.0), F.lit(50.0), F.lit(60.0)))
    return _read(spark, sf_dir, "events").select("event_id", *(_r(box[k]).alias(n) for k, n in enumerate("ltwh")))


@query("""
SELECT event_id, CAST(event_id % 3 > 0 AND value > 10 AS INTEGER) AS has_pitch, round_even(coalesce(CASE WHEN event_id % 5 > 0 THEN value END, 0) * 2, 6) AS area FROM events""")
def annotation_scores(spark, sf_dir):
    """What decides between rows of one track in a frame."""
    v, k = F.col("value"), F.col("event_id")
    score = preparation.annotation_score(F.when(k % 5 > 0, v), F.lit(2.0), F.when(k % 3 > 0, v), F.when(v > 10, v))
    return _read(spark, sf_dir, "events").select("event_id", score["has_pitch"].alias("has_pitch"), _r(score["area"]).alias("area"))


@query("SELECT p_partkey FROM part WHERE p_size % 5 < 3 AND p_partkey % 4 NOT IN (1, 2)")
def cards_active(spark, sf_dir):
    """reviewed cards of the first priorities."""
    k = F.col("p_partkey") % 4
    status = F.when(k == 1, " unverified").when(k == 2, "candidate_unreviewed ").when(k == 3, "verified")
    cards = _read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" P"), (F.col("p_size") % 5).cast("string")).alias("priority"), status.alias("status"))
    return preparation.active_cards(cards, "priority", "status").select("p_partkey")


@query("SELECT event_id, CASE WHEN value >= 40 THEN upper(event_type) END AS jersey FROM events")
def legible_recognised(spark, sf_dir):
    """F16: only legible rows are recognised."""
    rows = _read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return preparation.recognised(rows, "event_id", "value", 40.0, lambda some: some.select("event_id", F.upper("event_type").alias("jersey"))).select("event_id", "jersey")


@query("""
SELECT event_id, coalesce((event_id % 7) * 100 >= 500 OR (event_id % 7) * 100 + 29 = 429, false) OR event_type = 'error' AS again FROM events""")
def calls_retried(spark, sf_dir):
    """which calls are made again."""
    status = (F.col("event_id") % 7) * 100 + F.when(F.col("event_id") % 7 == 4, 29).otherwise(0)
    name = F.when(F.col("event_type") == "error", "ReadTimeout").otherwise(F.col("event_type"))
    return _read(spark, sf_dir, "events").select("event_id", preparation.retryable(status, name).alias("again"))


@query("""
WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'RAW' WHEN 1 THEN 'ASCEND' WHEN 2 THEN 'TRANSFER' WHEN 3 THEN 'MATCH' WHEN 4 THEN 'MISS' ELSE 'SWITCH' END AS kind FROM events)
SELECT 'raw' AS part, kind, count(*) AS n FROM e WHERE kind = 'RAW' GROUP BY kind UNION ALL SELECT 'events', kind, count(*) FROM e WHERE kind IN ('MATCH', 'MISS', 'SWITCH') GROUP BY kind
UNION ALL SELECT 'extra', kind, count(*) FROM e WHERE kind <> 'RAW' GROUP BY kind""")
def events_split(spark, sf_dir):
    """three views of an event table."""
    names = F.array(*(F.lit(x) for x in ("RAW", "ASCEND", "TRANSFER", "MATCH", "MISS", "SWITCH")))
    rows = _read(spark, sf_dir, "events").select("event_id", F.get(names, (F.col("event_id") % 6).cast("int")).alias("kind"))
    views = [v.select(F.lit(k).alias("part"), "kind") for k, v in preparation.event_tables(rows, "kind").items()]
    return views[0].unionByName(views[1]).unionByName(views[2]).groupBy("part", "kind").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) >= 4 AS propagable, bool_or(l_tax > 0.04) AS unmatched FROM lineitem GROUP BY l_orderkey")
def segments_flagged(spark, sf_dir):
    """long segments, and those with a detection without match."""
    segments = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_tax") <= 0.04).alias("matched"))
    return segments.select("l_orderkey", preparation.segment_flags(F.col("matched"), 4).alias("f")).select("l_orderkey", "f.*")


@query("""
WITH e AS (SELECT event_id, event_id // 10 AS frame, (event_id // 10) % 7 AS video, user_id, CASE user_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS team, value AS x, CAST(user_id % 20 AS DOUBLE) AS y FROM events),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, user_id ORDER BY x DESC, event_id) AS k FROM e WHERE event_id % 10 > 0) WHERE k = 1 AND team IS NOT NULL),
n AS (SELECT * FROM (SELECT p.video, p.frame, p.team, sqrt((p.x - b.x) ** 2 + (p.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY p.frame ORDER BY sqrt((p.x - b.x) ** 2 + (p.y - b.y) ** 2), p.event_id) AS k
  FROM p JOIN e b ON b.frame = p.frame AND b.event_id % 10 = 0) WHERE k = 1 AND d <= 25),
v AS (SELECT video, team, count(*) AS n, min(frame) AS first FROM n GROUP BY video, team)
SELECT video, team, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY n DESC, first) AS k FROM v) WHERE k = 1""")
def attacking_teams(spark, sf_dir):
    """The team nearest to the ball in most frames."""
    k = F.col("user_id") % 3
    e = _read(spark, sf_dir, "events").withColumn("frame", F.expr("event_id div 10")).withColumn("video", F.col("frame") % 7)
    e = e.select("video", "frame", F.col("user_id").alias("track_id"), F.when(k == 0, "left").when(k == 1, "right").alias("team"), F.col("value").alias("x"), (F.col("user_id") % 20).cast("double").alias("y"), F.col("value").alias("score"), F.col("event_id").alias("pos"))
    return preparation.attacking_team(e.where("pos % 10 > 0"), e.where("pos % 10 = 0").select("video", "frame", "x", "y"), 25.0)


@query("""
SELECT user_id, count(DISTINCT event_type) AS n_segments, count(*) AS n_detections, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY user_id""")
def segment_tracklets(spark, sf_dir):
    """Objects with their segments and frame ranges."""
    return preparation.tracklets_of(_read(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("SELECT p_partkey, p_name, p_size, 0 AS idx FROM part")
def cards_projected(spark, sf_dir):
    """A card's chosen fields after a constant index."""
    card = F.struct("p_partkey", "p_name", "p_size", "p_brand", "p_type")
    rows = _read(spark, sf_dir, "part").select(F.lit(0).alias("idx"), preparation.subset(card, ["p_partkey", "p_name", "p_size"]).alias("card"))
    return rows.select("idx", "card.*")


@query("SELECT event_type AS kind, printf('%.2f%%', avg(value)) AS \"Mean\", printf('%d', count(*)) AS \"Rows\" FROM events GROUP BY event_type")
def metrics_rendered(spark, sf_dir):
    """A table of measures as text."""
    rows = _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return preparation.rendered(rows, {"mean": "%.2f%%", "n": "%d"}, {"mean": "Mean", "n": "Rows"})


@query("""
WITH a AS (SELECT l_orderkey, count(*) AS n, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(parts, '') AS parts FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""")
def annotations_of_frames(spark, sf_dir):
    """Every frame with its annotations, or none."""
    rows = _read(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("frame"), "l_linenumber", "l_partkey", "l_suppkey")
    out = preparation.frame_annotations(_read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame")), rows, "frame", "l_linenumber")
    parts = F.transform("annotations", lambda a: a["l_partkey"].cast("string"))
    return out.select(F.col("frame").alias("o_orderkey"), F.size("annotations").cast("long").alias("n"), F.array_join(parts, ",").alias("parts"))


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE user_id % 2 = 0) WHERE k <= 3""")
def features_remembered(spark, sf_dir):
    """The last three features of each track still active."""
    e = _read(spark, sf_dir, "events").select("user_id", "event_id")
    return preparation.remembered(e, e.where("user_id % 2 = 0").select("user_id").distinct(), "user_id", "event_id", 3).select("user_id", "event_id")


@query("""
SELECT 'documents' AS dataset, CAST(doc_id AS VARCHAR) AS id, '/data/documents/' || doc_id AS path, length(trim(coalesce(text, ''))) > 0 AS has_text FROM documents
UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), '/data/benchmark/' || item_id, length(trim(coalesce(text, ''))) > 0 FROM benchmark""")
def captions_listed(spark, sf_dir):
    """Two caption sets in one table."""
    rows = lambda name, key: _read(spark, sf_dir, name).select(F.col(key).cast("string").alias("id"), "text")
    sets = {"documents": rows("documents", "doc_id"), "benchmark": rows("benchmark", "item_id")}
    return preparation.caption_rows(sets, "id", "text", "/data").select("dataset", "id", "path", "has_text")


@query("""
WITH s AS (SELECT l_orderkey, l_quantity AS start_s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS k FROM (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem WHERE l_discount > 0.05))
SELECT o_orderkey, CAST(k AS INTEGER) AS event_no, start_s, start_s + 2 AS end_s FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def legacy_converted(spark, sf_dir):
    """Spans of old analyses as numbered events of their labels."""
    span = F.struct(F.col("l_quantity").alias("start_s"), (F.col("l_quantity") + 2).alias("end_s"))
    old = _read(spark, sf_dir, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set(span)).alias("spans"))
    return preparation.legacy_events(_read(spark, sf_dir, "orders").select("o_orderkey"), old, "o_orderkey", "spans")


@query("""
WITH p AS (SELECT p_partkey, list_filter([1, 2, 3], lambda i: p_size % (i + 1) = 0) AS ids FROM part)
SELECT p_partkey, len(list_filter([3, 1], lambda i: list_contains(ids, i))) AS side, len(list_filter([2], lambda i: list_contains(ids, i))) AS goal,
 array_to_string(list_transform(list_filter([3, 1], lambda i: list_contains(ids, i)), lambda i: i * 10), ',') AS side_points FROM p""")
def lines_named(spark, sf_dir):
    """Keypoints to named lines."""
    ids = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.col("p_size") % (i + 1) == 0)
    points = F.map_from_arrays(ids, F.transform(ids, lambda i: i * 10))
    rows = _read(spark, sf_dir, "part").select("p_partkey", preparation.named_lines(points, {"side": [3, 1], "goal": [2]}).alias("lines"))
    size = lambda name: F.coalesce(F.size(F.col("lines")[name]), F.lit(0))
    count = lambda name: F.when(F.map_contains_key("lines", F.lit(name)), size(name)).otherwise(0).cast("long")
    joined = F.coalesce(F.array_join(F.col("lines")["side"].cast("array<string>"), ","), F.lit(""))
    return rows.select("p_partkey", count("side").alias("side"), count("goal").alias("goal"), joined.alias("side_points"))


@query("""
WITH c AS (SELECT c_custkey, c_nationkey AS k, unnest([0, 1920, 0, 1920]) AS u, unnest([0, 0, 1080, 1080]) AS v, unnest([0, 1, 2, 3]) AS corner FROM customer)
SELECT c_custkey, corner, round_even((u + 0.1 * v + k) / (0.001 * u + 0.002 * v + 1), 6) AS x, round_even((2 * v + 1) / (0.001 * u + 0.002 * v + 1), 6) AS y FROM c""")
def corners_on_pitch(spark, sf_dir):
    """The image's corners on the pitch."""
    d = lambda *row: F.array(*(x if hasattr(x, "cast") else F.lit(float(x)) for x in row))
    h = F.array(d(1, 0.1, F.col("c_nationkey").cast("double")), d(0, 2, 1), d(0.001, 0.002, 1))
    corners = F.array(*(geometry.project(h, F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (1920, 0), (0, 1080), (1920, 1080))))
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.posexplode(corners).alias("corner", "p"))
    return rows.select("c_custkey", "corner", _r("p.x").alias("x"), _r("p.y").alias("y"))


@query("SELECT p_partkey, p_name, p_size FROM part")
def parts_joined(spark, sf_dir):
    """Rows of a manifest, joined one to one."""
    part = _read(spark, sf_dir, "part")
    rows = merge.checked_manifest(part.select("p_partkey", "p_name"), part.select("p_partkey"), "p_partkey")
    return merge.one_to_one(rows, part.select("p_partkey", "p_size"), "p_partkey", ["p_size"]).select("p_partkey", "p_name", "p_size")


@query("""
SELECT event_id, user_id + 100000 * (row_number() OVER (PARTITION BY event_id // 50, user_id ORDER BY event_id) - 1) AS user_id FROM events""")
def track_ids_repaired(spark, sf_dir):
    """One id stands once in a frame."""
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", F.expr("event_id div 50").alias("frame"))
    return integrity.repaired_track_ids(rows, "frame", "user_id", ["event_id"]).select("event_id", F.col("user_id").cast("long").alias("user_id"))


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM (SELECT event_id, user_id, value * 1000 + event_id / 1e7 AS value FROM events)) WHERE k <= 8""")
def cards_screened(spark, sf_dir):
    """The eight most confident cards of a clip go on."""
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") * 1000 + F.col("event_id") / 1e7).alias("value"))
    return claims.screened(rows, "user_id", "value", "event_id").select("user_id", "event_id")


@query("SELECT s_nationkey AS k, max(s_acctbal) AS v FROM supplier GROUP BY s_nationkey UNION ALL SELECT c_nationkey, min(c_acctbal) FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier) GROUP BY c_nationkey")
def registry_upserted(spark, sf_dir):
    """New entries replace old ones of their name."""
    old = _read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_acctbal").alias("v"))
    new = _read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("v"))
    return merge.registry_upsert(old, new, "k").select("k", "v")


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'exact' WHEN event_id % 3 = 0 THEN 'model_mapped' WHEN value > 50 THEN 'candidate' ELSE 'not_applicable' END AS status FROM events""")
def statuses_mapped(spark, sf_dir):
    """The strongest mapping of each row."""
    k = F.col("event_id")
    return _read(spark, sf_dir, "events").select("event_id", claims.mapping_status(k % 5 == 0, k % 3 == 0, F.col("value") > 50).alias("status"))


@query("""
SELECT event_type, count(*) AS rows, count(*) FILTER (event_id % 3 = 0) AS ok, CAST(sum(event_id % 3) AS BIGINT) AS errors, CAST(sum(user_id % 2) AS BIGINT) AS warnings FROM events GROUP BY event_type""")
def severities_reported(spark, sf_dir):
    """Errors and warnings by split."""
    return integrity.severity_report(_read(spark, sf_dir, "events"), "event_type", F.col("event_id") % 3, F.col("user_id") % 2)


@query("SELECT event_id FROM events WHERE event_id % 4 = 3")
def citations_missing(spark, sf_dir):
    """rows that cite what is not there."""
    cited, known = F.array(F.col("user_id") % 3, F.col("event_id") % 4), F.array(*(F.lit(i).cast("long") for i in range(3)))
    rows = _read(spark, sf_dir, "events").select("event_id", cited.alias("cited"), known.alias("known"))
    return integrity.uncited(rows, "cited", "known").select("event_id")


@query("""
WITH h AS (SELECT DISTINCT l_orderkey AS o, l_linenumber % 3 AS tactic FROM lineitem WHERE l_tax > 0.02 AND l_discount * 1000 >= 50 AND least(l_quantity + 3, 30) > greatest(l_quantity, 10))
SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS covered, (o_orderkey, o_custkey % 3) IN (SELECT (o, tactic) FROM h) AS predicted FROM orders""")
def claims_matched(spark, sf_dir):
    """Claims that a run covers and supports with a span in their window."""
    window = {"start_s": F.lit(10.0), "end_s": F.lit(30.0)}
    asked = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_uid"), (F.col("o_custkey") % 3).alias("tactic_id"), *(v.alias(k) for k, v in window.items()))
    spans = F.array(F.struct(F.col("l_quantity").alias("start_s"), (F.col("l_quantity") + 3).alias("end_s")))
    said = F.struct((F.col("l_linenumber") % 3).cast("long").alias("tactic_id"), F.when(F.col("l_tax") > 0.02, "present").otherwise("absent").alias("verdict"),
                    (F.col("l_discount") * 1000).alias("confidence"), spans.alias("evidence_spans"))
    runs = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("clip_uid")).agg(F.collect_list(said).alias("assessments"))
    return claims.matched_claims(asked, runs, 50.0).select(F.col("clip_uid").alias("o_orderkey"), "covered", "predicted")


@query("""
WITH e AS (SELECT event_id // 10 AS image, value > 40 AS d, user_id % 2 = 0 AS ok, event_id % 3 > 0 AS t FROM events)
SELECT image, count(*) FILTER (d AND t AND ok) AS tp, count(*) FILTER (d AND NOT (t AND ok)) AS fp, count(*) FILTER (t AND NOT (d AND ok)) AS fn FROM e WHERE d OR t GROUP BY image""")
def lines_confused(spark, sf_dir):
    """Line classes found, wrong and missed in each image."""
    rows = _read(spark, sf_dir, "events").select(F.expr("event_id div 10").alias("image"), (F.col("event_id") % 10).alias("kind"), "event_id", "value", (F.col("user_id") % 2 == 0).alias("ok"))
    return claims.class_confusion(rows.where("value > 40"), rows.where("event_id % 3 > 0"), "image", "kind", "ok")


@query("""
WITH e AS (SELECT event_id % 2 AS side, user_id % 4 AS seq, user_id AS id, event_id // 20 AS t, value AS l, (user_id % 20) * 5.0 AS u FROM events),
n AS (SELECT side, seq, id, count(*) * 900.0 AS s FROM e GROUP BY ALL),
m AS (SELECT a.seq, a.id AS a_id, b.id AS b_id, sum(greatest(0, 30 - abs(a.l - b.l)) * greatest(0, 30 - abs(a.u - b.u))) AS i FROM e a JOIN e b ON a.side = 0 AND b.side = 1 AND a.seq = b.seq AND a.t = b.t GROUP BY ALL)
SELECT m.seq, a_id, b_id, round_even(i / (x.s + y.s - i), 6) AS iou FROM m JOIN n x ON x.side = 0 AND x.seq = m.seq AND x.id = a_id JOIN n y ON y.side = 1 AND y.seq = m.seq AND y.id = b_id""")
def tracks_overlapping(spark, sf_dir):
    """Overlap of whole tracks."""
    u = (F.col("user_id") % 20) * 5.0
    box = F.array(F.col("value"), u, F.col("value") + 30, u + 30)
    rows = _read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("seq"), F.col("user_id").alias("id"), F.expr("event_id div 20").alias("t"), box.alias("box"))
    out = tracking.track_overlap(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"))
    return out.select("seq", "a_id", "b_id", _r("iou").alias("iou"))


@query("""
WITH e AS (SELECT user_id % 5 AS seq, sqrt((event_id % 4) ** 2 + (event_id % 3) ** 2) AS d FROM events WHERE event_id % 2 = 0)
SELECT seq, round_even(avg(d), 6) AS distance, round_even(avg(exp(-d * d / (2 * 2.0427 * 2.0427))), 6) AS similarity FROM e GROUP BY seq""")
def distances_on_pitch(spark, sf_dir):
    """How far matched positions lie apart."""
    e = _read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("seq"), F.col("event_id").alias("t"), F.col("user_id").alias("id"), F.col("value").alias("x"), F.lit(0.0).alias("y"))
    other = e.select("seq", "t", (F.col("id") + 1000).alias("id"), (F.col("x") + F.col("t") % 4).alias("x"), (F.col("t") % 3).cast("double").alias("y"))
    matches = e.where("t % 2 = 0").select("seq", "t", F.col("id").alias("gt_id"), (F.col("id") + 1000).alias("tracker_id"))
    return tracking.pitch_distance(matches, e, other).select("seq", _r("distance").alias("distance"), _r("similarity").alias("similarity"))


@query("""
WITH e AS (SELECT user_id % 5 AS seq, user_id, event_id, CASE WHEN event_id % 4 > 0 THEN event_id // 400 END AS k FROM events),
l AS (SELECT seq, k = lag(k) OVER w AS same, lag(event_id) OVER w IS NOT NULL AS has FROM e WINDOW w AS (PARTITION BY seq, user_id ORDER BY event_id))
SELECT seq, round_even(coalesce(count(*) FILTER (same AND has) / nullif(count(*) FILTER (has), 0), 1.0), 6) AS "FragA" FROM l GROUP BY seq""")
def ids_kept(spark, sf_dir):
    """The share of neighbouring frames that keep their tracker id."""
    gt = _read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("seq"), F.col("event_id").alias("t"), F.col("user_id").alias("gt_id"))
    matches = gt.where("t % 4 > 0").withColumn("tracker_id", F.expr("t div 400"))
    return tracking.fragmentation(matches, gt).select("seq", _r("FragA").alias("FragA"))


@query("SELECT event_type, round_even(sum(value * (user_id % 2)) / greatest(1.0, sum(user_id % 2)), 6) AS mean FROM events GROUP BY event_type")
def means_weighted(spark, sf_dir):
    """Averages by weight."""
    mean = tracking.weighted_average(F.col("value"), F.col("user_id") % 2)
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(_r(mean).alias("mean"))


@query("""
SELECT c_custkey, c_nationkey % 5 > 0 AS valid, CASE WHEN c_nationkey % 5 > 0 THEN round_even(-c_nationkey / 2, 6) END AS shift, CASE WHEN c_nationkey % 5 > 0 THEN round_even(1 / 3, 6) END AS scale FROM customer""")
def cameras_inverted(spark, sf_dir):
    """Valid homographies and their inverses."""
    k = F.when(F.col("c_nationkey") % 5 > 0, F.col("c_nationkey").cast("double")).otherwise(float("nan"))
    d = lambda *row: F.array(*(x if hasattr(x, "cast") else F.lit(float(x)) for x in row))
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.array(d(2, 0, k), d(0, 3, 1), d(0, 0, 1)).alias("h"))
    back = geometry.inverse(F.col("h"))
    return rows.select("c_custkey", geometry.valid_matrix(F.col("h")).alias("valid"), _r(back[0][2]).alias("shift"), _r(back[1][1]).alias("scale"))
