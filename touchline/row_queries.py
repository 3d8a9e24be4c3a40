"""Queries of column functions and small operators over the driver's tables, with their SQL.

A line of an order stands for a box (quantity and discount its corner, tax and price its size), a part
for a clip, an event for a reply or a match; every query works on whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import boxes, geometry, text, timing
from .operators import library, merge, ranking, windows
from .queries import _r, _read, query

_BOX = "l_quantity AS l, l_discount * 100 AS t, l_tax * 100 + 1 AS w, l_extendedprice / 1000 AS h"
_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_K = ", ".join(_KEYS)


def _boxes(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem")
    return lines.select(*_KEYS, F.array(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100 + 1, F.col("l_extendedprice") / 1000).alias("box"))


def _four(box, names, digits=6):
    return [_r(box[k], digits).alias(n) for k, n in enumerate(names)]


@query(f"""
WITH b AS (SELECT {_K}, {_BOX} FROM lineitem)
SELECT {_K}, round_even(l + w, 6) AS r, round_even(t + h, 6) AS b, round_even(l + w / 2, 6) AS cx, round_even(t + h / 2, 6) AS cy, round_even(l, 6) AS back_l, round_even(h, 6) AS back_h FROM b""")
def box_formats(spark, sf_dir):
    """Corner and centre forms, there and back."""
    b = _boxes(spark, sf_dir)
    edges, middle = boxes.ltwh_to_ltrb(F.col("box")), boxes.ltwh_to_xywh(F.col("box"))
    back = boxes.ltrb_to_ltwh(boxes.xywh_to_ltrb(middle))
    out = {"r": edges[2], "b": edges[3], "cx": middle[0], "cy": middle[1], "back_l": back[0], "back_h": back[3]}
    return b.select(*_KEYS, *(_r(v).alias(k) for k, v in out.items()))


@query(f"""
WITH b AS (SELECT {_K}, {_BOX} FROM lineitem), c AS (SELECT *, greatest(0, least(l, 38)) AS sl, greatest(0, least(t, 18)) AS st FROM b)
SELECT {_K}, round_even(sl, 6) AS l, round_even(st, 6) AS t, round_even(greatest(1, least(w, 39 - sl)), 6) AS w, round_even(greatest(1, least(h, 19 - st)), 6) AS h,
 round_even(greatest(0, least(l + w, 40)), 6) AS clipped_r, round_even(greatest(0, least(t + h, 20)), 6) AS clipped_b, CAST(floor(l) AS BIGINT) AS out_l, CAST(ceil(l + w) AS BIGINT) AS out_r FROM c""")
def box_limits(spark, sf_dir):
    """Boxes inside an image of 40 by 20, and boxes of whole pixels."""
    b = _boxes(spark, sf_dir)
    size = (F.lit(40.0), F.lit(20.0))
    inside, edges = boxes.sanitized_ltwh(F.col("box"), *size), boxes.ltwh_to_ltrb(F.col("box"))
    clipped, pixels = boxes.clipped_ltrb(edges, *size), boxes.outward(edges)
    more = [_r(clipped[2]).alias("clipped_r"), _r(clipped[3]).alias("clipped_b"), pixels[0].cast("long").alias("out_l"), pixels[2].cast("long").alias("out_r")]
    return b.select(*_KEYS, *_four(inside, "ltwh"), *more)


@query(f"""
WITH b AS (SELECT {_K}, {_BOX} FROM lineitem), p AS (SELECT *, greatest(0, least(l + w, l + w + 2) - greatest(l, l + 2)) * greatest(0, least(t + h, t + h + 1) - greatest(t, t + 1)) AS i FROM b)
SELECT {_K}, round_even(i / (2 * w * h - i), 6) AS iou, round_even(i / (w * h), 6) AS of_first, round_even(i / (w * h), 6) AS of_second, round_even(sqrt(5), 6) AS apart,
 CASE WHEN i > 0 THEN round_even(1 - (1 - (1 - i / (2 * w * h - i))) * 0.5, 6) END AS cost FROM p""")
def overlap_shares(spark, sf_dir):
    """Each box against itself moved by two and one."""
    b = _boxes(spark, sf_dir).withColumn("x", boxes.ltwh_to_ltrb(F.col("box")))
    moved = F.array(F.col("x")[0] + 2, F.col("x")[1] + 1, F.col("x")[2] + 2, F.col("x")[3] + 1)
    b = b.withColumn("o", boxes.overlap(F.col("x"), moved)).withColumn("d", boxes.centre_distance(F.col("x"), moved))
    cost = boxes.fused_score(1 - F.col("o.iou"), F.lit(0.5))
    return b.select(*_KEYS, *(_r(f"o.{c}").alias(c) for c in ("iou", "of_first", "of_second")), _r(boxes.gated(F.col("d"), 3.0)).alias("apart"), F.when(F.col("o.iou") > 0, _r(cost)).alias("cost"))


_POINTS = "[{'x': l_quantity, 'y': l_tax * 100, 'c': l_discount}, {'x': l_quantity + 3, 'y': l_discount * 100, 'c': l_tax}, {'x': l_extendedprice / 1000, 'y': 5.0, 'c': l_linenumber - 2.0}]"


@query(f"""
WITH p AS (SELECT {_K}, list_filter({_POINTS}, lambda p: p.c > 0) AS s FROM lineitem),
m AS (SELECT *, list_min(list_transform(s, lambda p: p.x)) AS x1, list_max(list_transform(s, lambda p: p.x)) AS x2, list_min(list_transform(s, lambda p: p.y)) AS y1, list_max(list_transform(s, lambda p: p.y)) AS y2 FROM p)
SELECT {_K}, round_even(x1 - 0.1 * (x2 - x1), 6) AS l, round_even(y1 - 0.2 * (y2 - y1), 6) AS t, round_even((x2 - x1) * 1.2, 6) AS w, round_even((y2 - y1) * 1.5, 6) AS h FROM m""")
def keypoint_boxes(spark, sf_dir):
    """Extended boxes around the keypoints with confidence."""
    point = lambda x, y, c: F.struct(x.alias("x"), y.alias("y"), c.alias("c"))
    q, d, t, price = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice") / 1000
    points = F.array(point(q, t * 100, d), point(q + 3, d * 100, t), point(price, F.lit(5.0), F.col("l_linenumber") - F.lit(2.0)))
    return _read(spark, sf_dir, "lineitem").select(*_KEYS, *_four(boxes.box_of_keypoints(points, (0.1, 0.2, 0.3)), "ltwh"))


@query(f"""
WITH b AS (SELECT {_K}, {_BOX} FROM lineitem)
SELECT {_K}, round_even(l + w / 2, 6) AS x_center, round_even(t + h / 2, 6) AS y_center, round_even(l + w / 2, 0) AS foot_x, round_even(t + h, 0) AS foot_y FROM b""")
def image_boxes(spark, sf_dir):
    """Box structs and their foot points."""
    b = _boxes(spark, sf_dir).withColumn("s", geometry.image_box(F.col("box"))).withColumn("foot", geometry.foot_point(F.col("s")))
    return b.select(*_KEYS, _r("s.x_center").alias("x_center"), _r("s.y_center").alias("y_center"), F.col("foot.x").alias("foot_x"), F.col("foot.y").alias("foot_y"))


@query(f"""
WITH b AS (SELECT {_K}, {_BOX} FROM lineitem), s AS (SELECT *, greatest(0, least(1, ((l - 10) * 20 + (t - 2) * 5) / 425)) AS s FROM b)
SELECT {_K}, round_even(sqrt((l - 10 - s * 20) ** 2 + (t - 2 - s * 5) ** 2), 6) AS to_line, round_even(sqrt((l - 10) ** 2 + (t - 2) ** 2), 6) AS to_end FROM s""")
def segment_distances(spark, sf_dir):
    """Points against a segment and its end."""
    x, y, at = F.col("box")[0], F.col("box")[1], [F.lit(float(v)) for v in (10, 2, 30, 7)]
    return _boxes(spark, sf_dir).select(*_KEYS, _r(geometry.segment_distance(x, y, *at)).alias("to_line"), _r(geometry.distance(x, y, at[0], at[1])).alias("to_end"))


@query("""
WITH n AS (SELECT p_partkey, p_name || '__' || p_brand || ' - ' || (1890 + p_size * 5)::VARCHAR AS s FROM part)
SELECT p_partkey, lower(trim(regexp_extract(trim(regexp_replace(s, '[_\\s]+', ' ', 'g')), '^([^-]*)', 1))) AS team, nullif(regexp_extract(s, '((?:19|20)[0-9]{2})', 1), '') AS year FROM n""")
def names_and_years(spark, sf_dir):
    """Names before the separator and years."""
    name = F.concat("p_name", F.lit("__"), "p_brand", F.lit(" - "), (F.lit(1890) + F.col("p_size") * 5).cast("string"))
    return _read(spark, sf_dir, "part").select("p_partkey", text.name_and_year(name).alias("n")).select("p_partkey", "n.team", "n.year")


@query("""
WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '?' ELSE '' END || props AS reply, '  ' || upper(event_type) || ' ' AS role FROM events)
SELECT event_id, CASE WHEN reply NOT LIKE '%?%' THEN nullif(regexp_replace(reply, '[^0-9]', '', 'g'), '') END AS digits, CASE WHEN lower(trim(role)) IN ('click', 'view') THEN lower(trim(role)) END AS role FROM r""")
def replies_read(spark, sf_dir):
    """Digits and known roles of replies."""
    reply = F.concat(F.when(F.col("event_id") % 5 == 0, "?").otherwise(""), "props")
    role = F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))
    return _read(spark, sf_dir, "events").select("event_id", text.digits(reply).alias("digits"), text.known_role(role, ["click", "view"]).alias("role"))


@query("""
WITH w AS (SELECT p_partkey, p_size AS a, length(p_name) AS b, p_size % 3 = 0 AS odd FROM part)
SELECT p_partkey, CASE WHEN NOT odd AND a < b THEN CAST(a AS DOUBLE) END AS start_s, CASE WHEN NOT odd AND a < b THEN CAST(b AS DOUBLE) END AS end_s,
 a < 20 OR (a = 20 AND b < 9) AS old FROM w""")
def windows_and_versions(spark, sf_dir):
    """N19, F11: 'start:end' texts and versions; what can't be read is no window, and old."""
    b = F.length("p_name").cast("string")
    window = F.concat(F.col("p_size").cast("string"), F.lit(":"), b, F.when(F.col("p_size") % 3 == 0, ":1").otherwise(""))
    version = F.concat(F.col("p_size").cast("string"), F.lit("."), b)
    out = _read(spark, sf_dir, "part").select("p_partkey", text.parsed_window(window).alias("w"), text.older_than(version, 20, 9).alias("old"))
    return out.select("p_partkey", "w.start_s", "w.end_s", "old")


@query("""
WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'player' WHEN 'view' THEN 'goalkeeper' WHEN 'purchase' THEN 'referee' ELSE 'other' END AS role,
 CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS team, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS jersey FROM events)
SELECT event_id, CASE WHEN role IN ('player', 'goalkeeper') THEN role || '_' || team || CASE WHEN jersey <> 'x' THEN '_' || jersey ELSE '' END ELSE role END AS category FROM e""")
def categories(spark, sf_dir):
    """Role, team and jersey in one name."""
    kind = F.col("event_type")
    role = F.when(kind == "click", "player").when(kind == "view", "goalkeeper").when(kind == "purchase", "referee").otherwise("other")
    team = F.when(F.col("user_id") % 2 == 0, "left").otherwise("right")
    jersey = F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("user_id").cast("string"))
    return _read(spark, sf_dir, "events").select("event_id", text.category(role, team, jersey).alias("category"))


@query("""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\\s*[-*•]+\\s*', ''))), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, trim(text) AS t, len(list_filter(regexp_split_to_array(trim(text), '[.!?。！？]+'), lambda x: trim(x) <> '')) AS n FROM documents)
SELECT doc_id, len(l) AS n_lines, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::BIGINT AS n_chars,
 coalesce(length(t) BETWEEN 50 AND 140 AND n BETWEEN 2 AND 3 AND (contains(t, 'th') OR contains(t, 'er')), false) AS good FROM l JOIN s USING (doc_id)""")
def texts_checked(spark, sf_dir):
    """Lines without bullets, and whether a text is a fit comment."""
    lines = text.split_lines(F.col("text"))
    chars = F.aggregate(F.transform(lines, lambda x: F.length(x).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(lines).cast("long").alias("n_lines"), chars.alias("n_chars"), text.good_commentary(F.col("text"), ["th", "er"]).alias("good"))


@query("""
SELECT o_orderkey, round_even(o_orderkey / 8 * 0.5 + 7, 3) AS start_s, round_even((o_orderkey / 8 + 4) * 0.5 + 7, 3) AS end_s,
 CASE WHEN greatest(1, o_totalprice / 1000 / 200 * 1.01) <= 1.5 THEN round_even(greatest(1, o_totalprice / 1000 / 200 * 1.01), 6) END AS speed,
 round_even(greatest(0, least(1, (o_orderkey % 40 - 15 + 5) / 5.0, (6 + 10 + 15 - o_orderkey % 40) / 10.0)) * 0.8, 6) AS weight,
 greatest(0, o_orderkey % 40 - 5) AS first, least(37, o_orderkey % 40 + 1) AS last FROM orders""")
def spans_and_fades(spark, sf_dir):
    """Moved spans, tempo, fades and frame bounds."""
    at, k = F.col("o_orderkey") / 8, F.col("o_orderkey") % 40
    spans = timing.shifted_spans(F.array(F.struct(at.alias("start_s"), (at + 4).alias("end_s"))), F.lit(7.0), 0.5)[0]
    bounds = timing.frame_bounds(k, k - 4, F.lit(38).cast("long"), 5)
    return _read(spark, sf_dir, "orders").select(
        "o_orderkey", spans["start_s"].alias("start_s"), spans["end_s"].alias("end_s"), _r(timing.speed_to_fit(F.col("o_totalprice") / 1000, F.lit(200.0))).alias("speed"),
        _r(timing.trapezoid(k - 15, 5.0, 6.0, 10.0, 0.8)).alias("weight"), bounds["first"].alias("first"), bounds["last"].alias("last"),
    )


@query("""
WITH p AS (SELECT p_partkey, CAST(p_size AS INTEGER) AS n FROM part),
m AS (SELECT *, list_transform(range(8), lambda k: [k * n // 8, greatest((k + 1) * n // 8 - 1, k * n // 8)]) AS i FROM p)
SELECT p_partkey, array_to_string(CASE WHEN n >= 8 THEN list_transform(i, lambda x: (x[1] + x[2]) // 2) ELSE list_concat(range(n), list_transform(range(8 - n), lambda k: n - 1)) END, ',') AS frames FROM m""")
def frames_sampled(spark, sf_dir):
    """Eight frames of each clip."""
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(timing.sampled_frames(F.col("p_size"), 8).cast("array<string>"), ",").alias("frames"))


@query("""
WITH m AS (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN event_type END AS id FROM events),
b AS (SELECT *, last_value(id IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)
SELECT event_id, coalesce(id <> before, false) AS switch FROM b""")
def identity_switches(spark, sf_dir):
    """Matched rows that another tracker id than before holds."""
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", F.lit(0).alias("seq"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("id"))
    return windows.identity_switches(rows, "seq", "user_id", "event_id", "id").select("event_id", "switch")


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS f, value FROM events),
g AS (SELECT *, coalesce(CAST(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY f)) > 60 AS INTEGER), 0) AS b FROM e), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY f) AS r FROM g)
SELECT a.event_id, a.f FROM r a JOIN r p ON p.user_id = a.user_id AND p.f = 3 AND p.r = a.r""")
def rows_until_jump(spark, sf_dir):
    """The rows around each track's third one without a jump between."""
    order = F.row_number().over(windows.Window.partitionBy("user_id").orderBy("event_id"))
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", order.alias("f"), "value", F.lit(0.0).alias("y"), F.lit(3).alias("prompt"))
    return windows.until_jump(rows, "user_id", "f", "value", "y", "prompt", 60.0).select("event_id", F.col("f").cast("long").alias("f"))


@query("""
WITH p AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS pixel, l_linenumber AS mask_id, l_extendedprice AS score FROM lineitem)
SELECT l_orderkey, pixel, mask_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, pixel ORDER BY score DESC, mask_id) AS k FROM p) WHERE k = 1""")
def painted_pixels(spark, sf_dir):
    """The best mask of each pixel."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("pixel"), F.col("l_linenumber").alias("mask_id"), F.col("l_extendedprice").alias("score"))
    return ranking.painted(rows, "l_orderkey", "pixel")


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.quality IS DISTINCT FROM d.n_chars % 2 THEN 'stale' ELSE 'existing' END AS status
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def migration_states(spark, sf_dir):
    """Results that are missing, of another version, or there."""
    old = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("version"))
    new = _read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("version"))
    return library.migration_status(old, new, "doc_id", "version").select("doc_id", "status")


@query("""
SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_l_returnflag, count(DISTINCT l_linestatus) AS n_l_linestatus FROM lineitem GROUP BY l_orderkey
HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1""")
def inconsistent_orders(spark, sf_dir):
    """Orders whose lines disagree."""
    return library.inconsistent_groups(_read(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS label, arg_max(o_orderstatus, o_orderkey) AS role, max(CASE WHEN o_custkey % 3 > 0 AND o_orderkey % 2 = 0 THEN 'tactic ' || (o_custkey % 3)::VARCHAR END) AS tactic FROM orders GROUP BY o_custkey""")
def labels_consolidated(spark, sf_dir):
    """One role and one tactic of each label."""
    tactic = F.when((F.col("o_custkey") % 3 > 0) & (F.col("o_orderkey") % 2 == 0), F.concat(F.lit("tactic "), (F.col("o_custkey") % 3).cast("string"))).otherwise("  ")
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("label"), F.col("o_orderkey").alias("rank"), F.col("o_orderstatus").alias("role"), tactic.alias("tactic"))
    return library.consolidated_labels(rows, "label", "rank", "role", "tactic")


@query("""
SELECT user_id AS video, event_type AS pattern, round_even(max(value), 6) AS best, arg_max(event_id, value) AS best_at, count(*) FILTER (value > 50) AS hits, count(*) FILTER (value > 50 AND event_id % 4 = 0) AS periodic_hits,
 min(event_id) FILTER (value > 50) AS first, max(event_id) FILTER (value > 50) AS last FROM (SELECT *, value + event_id / 1e9 AS v FROM events) GROUP BY user_id, event_type""")
def pattern_hits(spark, sf_dir):
    """Hits of each pattern in each video."""
    e = _read(spark, sf_dir, "events").withColumnsRenamed({"user_id": "video", "event_type": "pattern"})
    out = library.pattern_statistics(e, "video", "pattern", "value", "event_id", F.col("value") > 50, F.col("event_id") % 4 == 0)
    return out.withColumn("best", _r("best"))


@query("SELECT o_orderkey AS a, c_nationkey AS c FROM orders JOIN customer ON o_custkey = c_custkey")
def matches_composed(spark, sf_dir):
    """Orders to customers to nations."""
    first = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    return merge.compose_matches(first, _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("b"), F.col("c_nationkey").alias("c")))[0]


@query("""
WITH p AS (SELECT s_suppkey AS k, s_acctbal AS a, c_acctbal AS b FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE abs(s_acctbal - c_acctbal) / 100 < 40)
SELECT 'a' AS side, s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM p WHERE a <= b) UNION ALL SELECT 'b', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT k FROM p WHERE a > b)""")
def duplicates_removed(spark, sf_dir):
    """Of close tracks the younger one goes."""
    a = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("age"))
    b = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("age"))
    other = b.select(F.col("id").alias("b_id"), F.col("age").alias("b_old"))
    pairs = a.select(F.col("id").alias("a_id"), F.col("age").alias("a_old")).join(other, F.expr("a_id = b_id")).select("a_id", "b_id", (F.abs(F.col("a_old") - F.col("b_old")) / 100).alias("distance"))
    x, y = merge.mutual_duplicates(a, b, pairs, 40.0)
    return x.select(F.lit("a").alias("side"), "id").unionByName(y.select(F.lit("b").alias("side"), "id"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def documents_subtracted(spark, sf_dir):
    """Documents without a good label."""
    return merge.subtract(_read(spark, sf_dir, "documents").select("doc_id", "lang"), _read(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query("""
SELECT p_partkey, CASE WHEN length(trim(p_name)) BETWEEN 8 AND 11 THEN p_name WHEN length(trim(p_type)) BETWEEN 8 AND 11 THEN p_type END AS chosen FROM part""")
def texts_chosen(spark, sf_dir):
    """The first text of a fit length."""
    return _read(spark, sf_dir, "part").select("p_partkey", library.chosen_text(F.array("p_name", "p_type"), 8, 11).alias("chosen"))
