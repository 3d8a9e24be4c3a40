"""Queries of whole tracks, run lengths, segments, cameras and joints, with their SQL.

An order stands for a track and its lines for the frames of it; a block of order keys is a sequence,
so the number of sequences grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .evaluation import track_precision as precision
from .operators import cleanup, segments
from .queries import _r, _read, query

_TRACKS = """
l AS (SELECT l_orderkey AS id, l_orderkey // 64 AS seq, l_linenumber AS t, (l_orderkey % 64) * 1000.0 AS x, CAST(l_quantity AS DOUBLE) AS w, 40.0 + 10 * l_linenumber AS h, l_suppkey FROM
  (SELECT l_orderkey, l_linenumber, l_quantity, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k = 1),
g AS (SELECT seq, id AS gt_id, t, x, x + w AS x2, 0.0 AS y, h AS y2 FROM l),
p AS (SELECT seq, id * 3 + j AS tracker_id, id, j, t, x + j * (l_suppkey % 3) AS x, x + w + j AS x2, 0.0 AS y, h - 3 * j AS y2 FROM l, (SELECT unnest([0, 1, 2]) AS j) WHERE j < 2 OR t % 3 > 0)"""


def _tracks(spark, sf_dir):
    """Truth and three predictions of each order; boxes of different orders of a sequence do not touch."""
    from pyspark.sql import Window

    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity")
    rows = _read(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(first)).where("k = 1")
    x, w, h = (F.col("l_orderkey") % 64) * 1000.0, F.col("l_quantity").cast("double"), 40.0 + 10 * F.col("l_linenumber")
    base = rows.select(
        F.col("l_orderkey").alias("id"), F.expr("l_orderkey div 64").alias("seq"), F.col("l_linenumber").cast("long").alias("t"), x.alias("x"), w.alias("w"), h.cast("double").alias("h"), "l_suppkey"
    )
    box = lambda *c: F.array(*(v.cast("double") for v in c)).alias("box")
    truth = base.select("seq", "id", "t", box(F.col("x"), F.lit(0.0), F.col("x") + F.col("w"), F.col("h")))
    j = F.col("j")
    three = base.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("j < 2 or t % 3 > 0")
    moved = box(F.col("x") + j * (F.col("l_suppkey") % 3), F.lit(0.0), F.col("x") + F.col("w") + j, F.col("h") - 3 * j)
    return truth, three.select("seq", (F.col("id") * 3 + j).alias("id"), "t", moved)


_RANGES = [("all", None, 0.0, 0.0), ("area_s", "area", 0.0, 1500.0), ("area_l", "area", 1500.0, 1e10), ("time_s", "frames", 0.0, 3.0), ("time_l", "frames", 4.0, 1e5)]
_LEVELS = [0.5, 0.75, 0.9]


@query(f"""
WITH {_TRACKS},
gs AS (SELECT seq, gt_id, avg((x2 - x) * greatest(y2 - y, 0)) AS area, count(*) AS frames, gt_id % 11 = 0 AS crowd, sum((x2 - x) * (y2 - y)) AS s FROM g GROUP BY seq, gt_id),
ps AS (SELECT seq, tracker_id, id, avg(greatest(x2 - x, 0) * greatest(y2 - y, 0)) AS area, count(*) AS frames, (tracker_id * 37 % 101) / 100.0 AS score, seq % 13 = 0 AS open,
  sum(greatest(x2 - x, 0) * (y2 - y)) AS s FROM p GROUP BY seq, tracker_id, id),
c AS (SELECT p.tracker_id, sum(greatest(least(p.x2, g.x2) - greatest(p.x, g.x), 0) * greatest(least(p.y2, g.y2) - greatest(p.y, g.y), 0)) AS i FROM p JOIN g ON g.gt_id = p.id AND g.t = p.t GROUP BY p.tracker_id),
o AS (SELECT ps.*, c.i / (ps.s + gs.s - c.i) AS iou FROM ps JOIN c USING (tracker_id) JOIN gs ON gs.gt_id = ps.id WHERE ps.s + gs.s - c.i > 0),
r(range, col, lo, hi) AS (VALUES ('all', 0, 0, 0), ('area_s', 1, 0, 1500), ('area_l', 1, 1500, 1e10), ('time_s', 2, 0, 3), ('time_l', 2, 4, 1e5)),
gin AS (SELECT range, gt_id, (col = 0 OR (CASE col WHEN 1 THEN area ELSE frames END BETWEEN lo AND hi)) AND NOT crowd AS counted FROM gs, r),
pin AS (SELECT range, seq, tracker_id, id, score, (col = 0 OR (CASE col WHEN 1 THEN area ELSE frames END BETWEEN lo AND hi)) AND NOT open AS counts FROM ps, r),
th(threshold) AS (VALUES (0.5), (0.75), (0.9)),
hit AS (SELECT threshold, tracker_id FROM (SELECT threshold, tracker_id, row_number() OVER (PARTITION BY threshold, id ORDER BY score DESC, tracker_id) AS k FROM o, th WHERE iou >= threshold - 2.3e-16) WHERE k = 1),
j AS (SELECT pin.range, th.threshold, seq, pin.tracker_id, score, CASE WHEN hit.tracker_id IS NULL THEN 0 ELSE 1 END AS h, gin.counted, counts FROM pin JOIN gin ON gin.range = pin.range AND gin.gt_id = pin.id CROSS JOIN th
  LEFT JOIN hit ON hit.threshold = th.threshold AND hit.tracker_id = pin.tracker_id),
u AS (SELECT * FROM j WHERE (h = 1 AND counted) OR (h = 0 AND counts)),
n AS (SELECT range, count(*) FILTER (counted) AS n_truth FROM gin GROUP BY range),
q AS (SELECT range, threshold, sum(h) OVER w AS tp, sum(1 - h) OVER w AS fp FROM u WINDOW w AS (PARTITION BY range, threshold ORDER BY score DESC, seq, tracker_id)),
b AS (SELECT range, threshold, tp * 100 // n_truth AS k, max(tp / (tp + fp + 2.220446049250313e-16)) AS p FROM q JOIN n USING (range) WHERE n_truth > 0 GROUP BY ALL),
a AS (SELECT range, threshold, sum(p) / 101 AS ap FROM (SELECT range, threshold, i, max(p) AS p FROM b, range(101) AS x(i) WHERE i <= k GROUP BY ALL) GROUP BY ALL),
e AS (SELECT range, threshold, sum(h) AS hits, count(*) AS n_predicted FROM u GROUP BY ALL)
SELECT range, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN n_truth > 0 THEN round_even(coalesce(ap, 0), 6) END AS ap, CASE WHEN n_truth > 0 THEN round_even(coalesce(hits / n_truth, 0), 6) END AS ar,
  n_truth, coalesce(n_predicted, 0) AS n_predicted FROM n CROSS JOIN th LEFT JOIN a USING (range, threshold) LEFT JOIN e USING (range, threshold)""")
def track_average_precision(spark, sf_dir):
    """Orders as tracks, each predicted three times; some are crowds, some sequences are labelled in part."""
    truth, predicted = _tracks(spark, sf_dir)
    score = F.col("id") * 37 % 101 / 100.0
    out = precision.box_track_precision(truth.withColumn("crowd", F.col("id") % 11 == 0), predicted.withColumn("score", score).withColumn("open", F.col("seq") % 13 == 0), _RANGES, _LEVELS)
    return out.select("range", "threshold", _r("ap").alias("ap"), _r("ar").alias("ar"), "n_truth", "n_predicted")


_MASKS = """
m AS (SELECT l_orderkey, l_linenumber AS place, [l_suppkey % 20, CAST(l_quantity AS BIGINT), l_partkey % 15, 10 + l_linenumber] AS c FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k = 1),
i AS (SELECT l_orderkey, place, c[1] AS b, c[1] + c[2] AS e FROM m UNION ALL SELECT l_orderkey, place, c[1] + c[2] + c[3], c[1] + c[2] + c[3] + c[4] FROM m)"""


def _segments(spark, sf_dir):
    """The lines of an order as segments of one frame, with masks of two runs and boxes."""
    from pyspark.sql import Window

    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity")
    rows = _read(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(first)).where("k = 1")
    counts = [F.col("l_suppkey") % 20, F.col("l_quantity").cast("long"), F.col("l_partkey") % 15, F.col("l_linenumber") + 10]
    x = (F.col("l_suppkey") % 20).cast("double")
    return rows.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("place"), (F.col("l_partkey") % 3).alias("obj_id"), F.concat_ws(" ", *(c.cast("string") for c in counts)).alias("mask"),
        F.array(x, F.lit(0.0), x + 10, F.col("l_quantity").cast("double")).alias("box"),
    )


@query(f"""
WITH {_MASKS}
SELECT a.l_orderkey, a.place AS earlier, b.place, CAST(sum(least(a.e, b.e) - greatest(a.b, b.b)) AS BIGINT) AS common
FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.place < b.place AND a.b < b.e AND b.b < a.e GROUP BY ALL""")
def runs_shared(spark, sf_dir):
    """Pixels that two masks of an image share, from run lengths."""
    rows = _segments(spark, sf_dir)
    a, b = rows.select("l_orderkey", F.col("place").alias("earlier"), "mask"), rows.select("l_orderkey", "place", "mask")
    return segments.shared_pixels(a, b, ["l_orderkey"], "earlier", "place", ordered=True)


@query()
def segments_matched(spark, sf_dir):
    """Segments against every second of their own boxes, moved; claims depend on the order, so SQL has no form of it."""
    rows = _segments(spark, sf_dir)
    moved = F.transform("box", lambda v, k: v + F.when(k % 2 == 0, (F.col("place") % 4).cast("double")).otherwise(0.0))
    dets = rows.where("place % 2 = 1").select("l_orderkey", F.col("place").alias("det"), moved.alias("box"))
    return segments.match_segments(rows, dets, ["l_orderkey"])


@query()
def boxes_cleaned(spark, sf_dir):
    """Each user's events by the hour as a track, from its tenth frame outward; a recursion over rows, so SQL has no plain form of it."""
    from pyspark.sql import Window

    e = _read(spark, sf_dir, "events")
    by = Window.partitionBy("user_id").orderBy("event_id")
    rows = e.withColumn("frame", F.row_number().over(by).cast("long"))
    x = F.col("value") * 2
    box = F.array(x, x, x + 60 + F.col("value") * (F.col("event_id") % 5), x + 80 + F.col("value"))
    rows = rows.select("user_id", "frame", F.lit(10).cast("long").alias("prompt"), box.alias("box"), (F.col("event_id") % 17 > 0).alias("valid"), (F.col("event_id") % 3).alias("pieces"))
    out = cleanup.clean_outward(rows, ["user_id"], "frame", "prompt")
    return out.select("user_id", "frame", *(_r(F.col("box")[k]).alias(n) for k, n in enumerate("ltrb")), "valid", "constrained", "outlier", "reached")


def _panned(spark, sf_dir):
    """The boxes of blocks of users, seen by a camera that pans by a hundredth of a box in each hour, and its motion."""
    from .queries import _boxes_by_frame
    from .streaming import moving

    rows = _boxes_by_frame(spark, sf_dir)
    shift = F.col("frame").cast("double") % 1000 * 0.3
    seen = F.transform("box", lambda v, k: v - F.when(k % 2 == 0, shift).otherwise(0.0))
    features = F.array(*(F.cos(F.col("det_id") % 5 + k) for k in range(3)))
    motion = rows.select("video_id", "frame").distinct().withColumn("pan", F.when(F.col("frame") % 1000 == 0, 999 * 0.3).otherwise(-0.3))
    motion = motion.select("video_id", "frame", F.array(*(F.lit(float(v)) if v != "pan" else F.col("pan") for v in (1, 0, "pan", 0, 1, 0))).alias("warp"))
    return moving.with_motion(rows.withColumn("box", seen).withColumn("features", features), motion)


@query()
def camera_tracks(spark, sf_dir):
    """Under a panning camera; a filter's state goes from frame to frame, so SQL has no form of it."""
    from .streaming import trackers

    return trackers.track_batch(_panned(spark, sf_dir), "camera")


@query()
def deep_tracks(spark, sf_dir):
    """The same by overlap, direction and appearance."""
    from .streaming import trackers

    return trackers.track_batch(_panned(spark, sf_dir), "deep_observation_centric")


@query(f"""
WITH {_MASKS},
s AS (SELECT l_orderkey, place, p // 12 AS c, p % 12 AS y FROM (SELECT l_orderkey, place, unnest(range(b, least(e, 120))) AS p FROM i)),
n AS (SELECT l_orderkey, place, count(*) AS n FROM s GROUP BY ALL),
v AS (SELECT l_orderkey, place, c - dc AS c, y - dy AS y, count(*) AS n FROM s, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dc, dy) WHERE c >= dc AND y >= dy GROUP BY ALL),
e AS (SELECT l_orderkey, place, c, y FROM v WHERE (y < 11 AND c < 9 AND n < 4) OR (((y = 11) <> (c = 9)) AND n = 1)),
g AS (SELECT DISTINCT l_orderkey, place, c + dc AS c, y + dy AS y FROM e, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) AS d(dc, dy)),
pair AS (SELECT a.l_orderkey, a.place AS a, b.place AS b FROM m a JOIN m b ON a.l_orderkey = b.l_orderkey AND b.place = a.place + 1),
ne AS (SELECT l_orderkey, place, count(*) AS n FROM e GROUP BY ALL),
hit AS (SELECT p.l_orderkey, p.a, p.b, (SELECT 0) AS z, count(*) FILTER (side = 1) AS h1, count(*) FILTER (side = 2) AS h2 FROM (
  SELECT p.*, 1 AS side FROM pair p JOIN e ON e.l_orderkey = p.l_orderkey AND e.place = p.a JOIN g ON g.l_orderkey = p.l_orderkey AND g.place = p.b AND g.c = e.c AND g.y = e.y
  UNION ALL SELECT p.*, 2 FROM pair p JOIN e ON e.l_orderkey = p.l_orderkey AND e.place = p.b JOIN g ON g.l_orderkey = p.l_orderkey AND g.place = p.a AND g.c = e.c AND g.y = e.y) p GROUP BY ALL),
inter AS (SELECT p.l_orderkey, p.a, count(*) AS k FROM pair p JOIN s x ON x.l_orderkey = p.l_orderkey AND x.place = p.a JOIN s y ON y.l_orderkey = p.l_orderkey AND y.place = p.b AND x.c = y.c AND x.y = y.y GROUP BY ALL),
r AS (SELECT p.l_orderkey, p.a, coalesce(k, 0) AS k, coalesce(na.n, 0) AS na, coalesce(nb.n, 0) AS nb, coalesce(ea.n, 0) AS ea, coalesce(eb.n, 0) AS eb, coalesce(h1, 0) AS h1, coalesce(h2, 0) AS h2 FROM pair p
  LEFT JOIN inter USING (l_orderkey, a) LEFT JOIN hit USING (l_orderkey, a) LEFT JOIN n na ON na.l_orderkey = p.l_orderkey AND na.place = p.a LEFT JOIN n nb ON nb.l_orderkey = p.l_orderkey AND nb.place = p.b
  LEFT JOIN ne ea ON ea.l_orderkey = p.l_orderkey AND ea.place = p.a LEFT JOIN ne eb ON eb.l_orderkey = p.l_orderkey AND eb.place = p.b)
SELECT l_orderkey, a AS place, round_even(CASE WHEN na + nb = 0 THEN 0 ELSE k / (na + nb - k) END, 6) AS j,
  round_even(CASE WHEN ea = 0 AND eb = 0 THEN 1 WHEN ea = 0 OR eb = 0 OR h1 + h2 = 0 THEN 0 ELSE 2 * (h1 / ea) * (h2 / eb) / (h1 / ea + h2 / eb) END, 6) AS f FROM r""")
def region_and_boundary(spark, sf_dir):
    """Neighbouring lines of an order as two masks of an image of 12 by 10 pixels."""
    from .functions import masks

    rows = _segments(spark, sf_dir)
    after = rows.select("l_orderkey", (F.col("place") - 1).alias("place"), F.col("mask").alias("other"))
    both = rows.select("l_orderkey", "place", "mask").join(after, ["l_orderkey", "place"])
    h, w = F.lit(12), F.lit(10)
    return both.select("l_orderkey", "place", _r(masks.mask_iou("mask", "other", h, w)).alias("j"), _r(masks.boundary_score("mask", "other", h, w)).alias("f"))


@query()
def region_scores(spark, sf_dir):
    """Blocks of orders as sequences, lines as objects over sixteen frames; the best assignment has no form in SQL."""
    from .evaluation import regions
    from .session import stored

    rows = _segments(spark, sf_dir).select(F.expr("l_orderkey div 64").alias("seq"), (F.col("l_orderkey") % 16).alias("t"), F.col("place").alias("id"), "mask", "obj_id", "l_orderkey")
    row = F.struct("l_orderkey", "mask")
    one = rows.groupBy("seq", "id", "t").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    one = stored(one.select("seq", "id", "t", F.col("first.mask").alias("mask"), F.col("last.mask").alias("other")))
    truth, predicted = one.select("seq", "id", "t", "mask"), one.select("seq", ((F.col("id") + 2) % 7).alias("id"), "t", F.col("other").alias("mask"))
    images = one.select("seq").distinct().select("seq", F.lit(16).cast("long").alias("n_frames"), F.lit(12).alias("h"), F.lit(10).alias("w"))
    out = regions.region_scores(truth, predicted, images)
    return out.select("seq", "n_tracks", *(_r(c).alias(c) for c in [*regions.FIELDS, "jf_mean"]))


@query("""
WITH l AS (SELECT l_orderkey AS frame, l_linenumber AS id, l_quantity AS q, l_discount * 100 AS d, l_tax * 100 AS t, l_suppkey % 7 AS s, l_partkey % 5 AS p FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k = 1),
g AS (SELECT frame, id AS gt_id, 4.0 + t AS head, j, x, y FROM (SELECT frame, id, t, unnest([0, 1, 2]) AS j, unnest([q, q + d, 20.0]) AS x, unnest([d, t, d + 3]) AS y FROM l)),
r AS (SELECT frame, id AS pred_id, j, x, y, c FROM (SELECT frame, id, unnest([0, 1, 2]) AS j, unnest([q + s, q + d + p, 20.0 + s]) AS x, unnest([d, t + 1, d + 3 - p]) AS y, unnest([s / 7.0, p / 5.0, q / 50]) AS c FROM l WHERE id % 5 > 0)),
m AS (SELECT g.frame, gt_id, pred_id, j, g.x > 0 AND g.y > 0 AND r.x > 0 AND r.y > 0 AND sqrt((g.x - r.x) ** 2 + (g.y - r.y) ** 2) <= 0.5 * head AS hit, g.x > 0 AND g.y > 0 AS there FROM g JOIN r USING (frame, j)),
s AS (SELECT frame, gt_id, pred_id, count(*) FILTER (hit) / count(*) FILTER (there) AS share FROM m GROUP BY ALL HAVING count(*) FILTER (hit) > 0),
a AS (SELECT *, row_number() OVER (PARTITION BY frame, pred_id ORDER BY share DESC, gt_id) AS k FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY frame, gt_id ORDER BY share DESC, pred_id) AS n FROM a WHERE k = 1),
o AS (SELECT r.frame, r.pred_id, r.j, r.c, CASE WHEN m.hit THEN 1 ELSE 0 END AS hit FROM r LEFT JOIN (SELECT * FROM b WHERE n = 1) b ON b.frame = r.frame AND b.pred_id = r.pred_id
  LEFT JOIN m ON m.frame = b.frame AND m.gt_id = b.gt_id AND m.pred_id = b.pred_id AND m.j = r.j WHERE r.x > 0 AND r.y > 0),
n AS (SELECT j, count(*) FILTER (x > 0 AND y > 0) AS n FROM g GROUP BY j),
c AS (SELECT j, sum(hit) OVER w AS tp, count(*) OVER w AS seen, c, frame, pred_id FROM o WINDOW w AS (PARTITION BY j ORDER BY c DESC, frame, pred_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT j, tp, max(tp / seen) AS p FROM c WHERE tp > 0 GROUP BY j, tp),
f AS (SELECT j, tp, max(p) OVER (PARTITION BY j ORDER BY tp DESC ROWS UNBOUNDED PRECEDING) AS p FROM e),
ap AS (SELECT j, sum(p) / any_value(n) AS ap FROM f JOIN n USING (j) GROUP BY j),
z AS (SELECT j, 100 * coalesce(ap, 0) AS ap, 100 * coalesce(hits / seen, 0) AS precision, 100 * coalesce(hits / n, 0) AS recall FROM n LEFT JOIN ap USING (j) LEFT JOIN (SELECT j, sum(hit) AS hits, count(*) AS seen FROM o GROUP BY j) USING (j)),
parts(part, j) AS (VALUES ('Upper', 0), ('Upper', 1), ('Lower', 2), ('Total', 0), ('Total', 1), ('Total', 2))
SELECT part, round_even(avg(ap), 4) AS ap, round_even(avg(precision), 4) AS precision, round_even(avg(recall), 4) AS recall FROM parts JOIN z USING (j) GROUP BY part""")
def pose_precision(spark, sf_dir):
    """The lines of an order as poses of three joints, most of them predicted somewhat aside."""
    from pyspark.sql import Window

    from .evaluation import pose

    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity")
    rows = _read(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(first)).where("k = 1")
    q, d, t, s, p = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_suppkey") % 7, F.col("l_partkey") % 5
    point = lambda x, y, *c: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), *(v.cast("double").alias("c") for v in c))
    at = [F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long")]
    truth = rows.select(at[0], at[1].alias("gt_id"), F.array(point(q, d), point(q + d, t), point(F.lit(20.0), d + 3)).alias("points"), (4 + t).alias("head"))
    said = F.array(point(q + s, d, s / 7), point(q + d + p, t + 1, p / 5), point(20 + s, d + 3 - p, q / 50))
    predicted = rows.where("l_linenumber % 5 > 0").select(at[0], at[1].alias("pred_id"), said.alias("points"))
    out = pose.pose_precision(truth, predicted, 0.5, {"Upper": [0, 1], "Lower": [2]}, 3)
    return out.select("part", *(_r(c, 4).alias(c) for c in ("ap", "precision", "recall")))


@query("""
WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'MATCH' WHEN 'view' THEN 'SWITCH' WHEN 'error' THEN 'MISS' ELSE 'FP' END AS type, concat('s', user_id // 16) AS seq, value, user_id FROM events),
o AS (SELECT seq, user_id, count(*) FILTER (type IN ('MATCH', 'SWITCH')) AS d, count(*) FILTER (type <> 'FP') AS n, count(*) FILTER (type = 'SWITCH') AS s, count(*) FILTER (type = 'MISS') AS m, count(*) FILTER (type = 'FP') AS f,
  sum(value) FILTER (type IN ('MATCH', 'SWITCH')) AS dist FROM e GROUP BY ALL),
b AS (SELECT * FROM o UNION ALL SELECT 'OVERALL', * EXCLUDE (seq) FROM o),
g AS (SELECT seq, sum(d) AS d, sum(n) AS n, sum(s) AS s, sum(m) AS m, sum(f) AS f, sum(dist) AS dist, count(*) FILTER (n > 0) AS u, count(*) FILTER (n > 0 AND d / n >= 0.8) AS mt, count(*) FILTER (n > 0 AND d / n < 0.2) AS ml FROM b GROUP BY seq)
SELECT seq, round_even(1 - CASE WHEN n > 0 THEN (m + s + f) / n END, 6) AS mota, round_even(CASE WHEN d > 0 THEN dist / d END, 6) AS motp, round_even(CASE WHEN 2 * d + f + m > 0 AND d > 0 THEN 2 * (d / (d + f)) * (d / n) / (d / (d + f) + d / n) END, 6) AS f1,
  CAST(u AS BIGINT) AS num_unique_objects, CAST(mt AS BIGINT) AS mostly_tracked, CAST(ml AS BIGINT) AS mostly_lost FROM g""")
def metrics_registered(spark, sf_dir):
    """Metrics of each block of users and of all, resolved by name, over one scan."""
    from .evaluation import registry

    kind = F.when(F.col("event_type") == "click", "MATCH").when(F.col("event_type") == "view", "SWITCH").when(F.col("event_type") == "error", "MISS").otherwise("FP")
    e = _read(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.expr("user_id div 16").cast("string")).alias("seq"), kind.alias("type"), F.col("user_id").alias("oid"), "value")
    e = e.withColumn("distance", F.when(F.col("type").isin("MATCH", "SWITCH"), F.col("value")))
    r = registry.tracking_registry()
    r.metrics.pop("num_unique_objects")
    r.per_object(lambda num_objects: F.count_if(num_objects > 0), name="num_unique_objects")
    asked = ["mota", "motp", "f1", "num_unique_objects", "mostly_tracked", "mostly_lost"]
    out = r.compute_many(e, asked, "seq")
    return out.select("seq", *(_r(c).alias(c) for c in asked[:3]), *(F.col(c).cast("long").alias(c) for c in asked[3:]))


@query("""
WITH l AS (SELECT l_orderkey // 64 AS seq, l_linenumber AS t, l_orderkey AS id, l_quantity AS q, l_suppkey FROM lineitem),
gf AS (SELECT seq, sum(k - 1) AS twice FROM (SELECT seq, t, id, count(*) AS k FROM l GROUP BY ALL) WHERE k > 1 GROUP BY seq),
bad AS (SELECT seq FROM (SELECT seq, t, id, count(*) AS k FROM l GROUP BY ALL) GROUP BY seq HAVING max(k) > 1),
run AS (SELECT DISTINCT seq FROM l WHERE seq NOT IN (SELECT seq FROM bad))
SELECT tracker, CAST(seq AS VARCHAR) AS seq, CAST(count(*) AS DOUBLE) AS gt_dets, CAST(count(*) FILTER (tracker = 'a' OR l_suppkey % 3 > 0) AS DOUBLE) AS dets FROM l SEMI JOIN run USING (seq), (VALUES ('a'), ('b')) AS x(tracker) GROUP BY ALL
UNION ALL SELECT tracker, 'COMBINED', CAST(count(*) AS DOUBLE), CAST(count(*) FILTER (tracker = 'a' OR l_suppkey % 3 > 0) AS DOUBLE) FROM l SEMI JOIN run USING (seq), (VALUES ('a'), ('b')) AS x(tracker) GROUP BY tracker
UNION ALL SELECT tracker, concat('fault ', seq), NULL, NULL FROM bad, (VALUES ('a'), ('b')) AS x(tracker)""")
def evaluation_run(spark, sf_dir):
    """Two trackers over all sequences; sequences in which an order has a line number twice are faults, and the others' counts stay."""
    from .evaluation import run

    x = (F.col("l_orderkey") % 64) * 100.0
    rows = _read(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 64").alias("seq"), F.col("l_linenumber").cast("long").alias("t"), F.col("l_orderkey").alias("id"), F.array(x, F.lit(0.0), x + F.col("l_quantity"), F.lit(50.0)).alias("box"), "l_suppkey"
    )
    gt = rows.select("seq", "t", F.col("id").alias("gt_id"), "box")
    kept = rows.withColumn("tracker", F.explode(F.array(F.lit("a"), F.lit("b")))).where("tracker = 'a' or l_suppkey % 3 > 0")
    results, errors = run.evaluate(gt, kept.select("tracker", "seq", "t", F.col("id").alias("tracker_id"), "box"), ["Identity"])
    counts = results.where("metric = 'Count' and field in ('gt_dets', 'dets')").groupBy("tracker", "seq").pivot("field", ["gt_dets", "dets"]).agg(F.first("value"))
    faults = errors.where("error like 'truth%'").select("tracker", F.concat(F.lit("fault "), F.col("seq").cast("string")).alias("seq")).distinct()
    return counts.select("tracker", "seq", "gt_dets", "dets").unionByName(faults.withColumn("gt_dets", F.lit(None).cast("double")).withColumn("dets", F.lit(None).cast("double")))
