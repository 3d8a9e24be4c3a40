"""What goes before evaluation and recognition: gates, ignore regions, distractors, look-ups and projections."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..evaluation.assignment import assign
from ..functions import boxes
from .joins import nearest
from .ranking import best_row, top_k

#: Truth classes that are no targets, by name.
DISTRACTORS = ("person_on_vhcl", "static_person", "distractor", "reflection")
#: Events that only tell of the pairing of ids over time.
TRANSFERS = ("ASCEND", "TRANSFER", "MIGRATE")
#: Transport errors after which a call is made again.
TRANSPORT_ERRORS = (
    "APITimeoutError", "APIConnectionError", "RateLimitError", "InternalServerError", "ConnectError",
    "ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout",
)


def above(rows: DataFrame, score: str, least: float) -> DataFrame:
    """rows of a score strictly above the threshold, of all sequences at once."""
    return rows.where(F.col(score) > least)


def overlap_with_polygon(polygon: Column, box: Column) -> Column:
    """Area that an ltrb box shares with a simple polygon (array of structs x, y), concave ones included.

    The polygon is cut at the four edges of the box in turn. Areas are exact, not counted in pixels.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    edge = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    edges = F.array(edge(one, zero, box[0]), edge(-one, zero, -box[2]), edge(zero, one, box[1]), edge(zero, -one, -box[3]))
    before = lambda points, i: F.get(points, F.pmod(i - 1, F.size(points)))

    def cut(points: Column, e: Column) -> Column:
        side = lambda p: e["a"] * p["x"] + e["b"] * p["y"] - e["c"]

        def corner(p: Column, i: Column) -> Column:
            q = before(points, i)
            at, last = side(p), side(q)
            share = last / F.nullif(last - at, zero)
            cross = F.struct((q["x"] + (p["x"] - q["x"]) * share).alias("x"), (q["y"] + (p["y"] - q["y"]) * share).alias("y"))
            none = F.slice(F.array(p), 1, 0)
            return F.when((at >= 0) & (last >= 0), F.array(p)).when(at >= 0, F.array(cross, p)).when(last >= 0, F.array(cross)).otherwise(none)

        return F.flatten(F.transform(points, corner))

    double = F.transform(polygon, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))

    def area(points: Column) -> Column:
        parts = F.transform(points, lambda p, i: before(points, i)["x"] * p["y"] - p["x"] * before(points, i)["y"])
        return F.abs(F.aggregate(parts, zero, lambda a, x: a + x)) / 2

    return F.aggregate(edges, double, cut, area)


def ignored(detections: DataFrame, regions: DataFrame, image: str, box: str, share: float = 0.9) -> DataFrame:
    """Adds ``ignored``: whether more than ``share`` of a box lies in one region (image, polygon) of its image."""
    per = regions.groupBy(F.col(image).alias("__image")).agg(F.collect_list("polygon").alias("__regions"))
    joined = detections.join(per, F.col(image) == F.col("__image"), "left")
    inside = F.exists("__regions", lambda r: overlap_with_polygon(r, F.col(box)) > share * boxes.area(F.col(box)))
    return joined.select(*detections.columns, F.coalesce(inside, F.lit(False)).alias("ignored"))


def _frame_assignment(pdf: pd.DataFrame) -> pd.DataFrame:
    truths, row = np.unique(pdf["truth_id"], return_inverse=True)
    preds, column = np.unique(pdf["pred_id"], return_inverse=True)
    cost = np.full((len(truths), len(preds)), np.nan)
    cost[row, column] = 1 - pdf["iou"]
    r, c = assign(cost)
    return pd.DataFrame({"frame": pdf["frame"].iloc[0], "truth_id": truths[r], "pred_id": preds[c]})


def without_distractors(pred: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """predictions (frame, pred_id, box) less those assigned to a distractor.

    ``truth`` has frame, truth_id, box ltrb and distractor. In each frame as many pairs of an overlap of
    ``least`` or more are assigned as can be, at the least cost; those that have no rival need no solver.
    """
    t = truth.select(F.col("frame").alias("__f"), "truth_id", F.col("box").alias("__box"), "distractor")
    pairs = pred.join(t, F.col("frame") == F.col("__f")).withColumn("iou", boxes.iou(F.col("box"), F.col("__box"))).where(F.col("iou") >= least)
    rivals = lambda key: F.count("*").over(Window.partitionBy("frame", key))
    pairs = pairs.select("frame", "truth_id", "pred_id", "iou", "distractor").withColumn("alone", (rivals("truth_id") == 1) & (rivals("pred_id") == 1))
    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("frame", "truth_id", "pred_id"))
    solved = pairs.where("not alone").select("frame", "truth_id", "pred_id", "iou").groupBy("frame").applyInPandas(_frame_assignment, schema)
    bad = truth.where("distractor").select("frame", "truth_id")
    gone = solved.join(bad, ["frame", "truth_id"], "left_semi").select("frame", "pred_id")
    gone = gone.unionByName(pairs.where("alone and distractor").select("frame", "pred_id"))
    return pred.join(gone, ["frame", "pred_id"], "left_anti")


def benchmark_truth(truth: DataFrame, confidence: str, kind: str, target: int = 1, least: float = 0.99) -> DataFrame:
    """Truth rows that count: sure enough and of the target class."""
    return truth.where((F.col(confidence) >= least) & (F.col(kind) == target))


def keypoint_similarity(points: Column, candidate: Column, kappas: list[float]) -> Column:
    """Similarity of keypoints (arrays of structs x, y, c) from 0 to 1; null without extent or visible points.

    The scale is the root of the visible extent, enlarged by the root of what all points span over it,
    upright or turned by 45 degrees, whichever is less, five times at most.
    """
    half = F.sqrt(F.lit(0.5))
    upright = (lambda p: p["x"], lambda p: p["y"])
    turned = (lambda p: (p["x"] - p["y"]) * half, lambda p: (p["x"] + p["y"]) * half)
    square = lambda v: v * v
    spread = F.array(*(F.lit(k) for k in kappas))

    def once(value: Column, then: Callable[[Column], Column]) -> Column:
        """``then`` of a value that is computed once for a row, not wherever it is used."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def extent(some: Column, axes) -> Column:
        wide, high = (once(F.transform(some, a), lambda v: F.array_max(v) - F.array_min(v)) for a in axes)
        return wide * high

    def extents(seen: Column, every: Column) -> Column:
        return F.struct(F.size(seen).alias("n"), *(extent(some, axes).alias(n) for n, some, axes in (("s", seen, upright), ("e", every, upright), ("ts", seen, turned), ("te", every, turned))))

    def measured(e: Column) -> Column:
        growth = [F.when(e[s] > 0.1, e[t] / e[s]) for s, t in (("s", "e"), ("ts", "te"))]
        factor = F.least(F.lit(5.0), F.sqrt(F.coalesce(F.least(*growth), F.lit(float("inf")))))
        return F.struct(e["n"].alias("n"), (F.sqrt(e["s"]) * factor).alias("scale"))

    def similarity(both: Column, m: Column) -> Column:
        def part(p: Column, i: Column) -> Column:
            near = lambda q: F.exp(-(square(p["x"] - q["x"]) + square(p["y"] - q["y"])) / (2 * square(m["scale"]) * square(F.get(spread, i))))
            return F.when(p["c"] > 0, once(F.get(both["candidate"], i), near)).otherwise(0.0)

        total = F.aggregate(F.transform(both["points"], part), F.lit(0.0), lambda a, x: a + x)
        return F.when((m["n"] > 0) & (m["scale"] >= 0.1), total / m["n"])

    def judged(both: Column) -> Column:
        seen = F.filter(both["points"], lambda p: p["c"] > 0)
        return once(once(once(seen, lambda s: extents(s, both["points"])), measured), lambda m: similarity(both, m))

    return once(F.struct(points.alias("points"), candidate.alias("candidate")), judged)


def recognised(rows: DataFrame, key: str, score: str, least: float, recognise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """F16: only rows legible enough are sent on; all come back, the others with nulls. ``recognise`` keeps the key."""
    return rows.join(recognise(rows.where(F.col(score) >= least)), key, "left")


def active_cards(cards: DataFrame, priority: str, status: str) -> DataFrame:
    """cards of the first three priorities that were reviewed."""
    first = F.trim(F.coalesce(priority, F.lit(""))).isin("P0", "P1", "P2")
    return cards.where(first & ~F.trim(F.coalesce(status, F.lit(""))).isin("candidate_unreviewed", "unverified"))


def retryable(status: Column, name: Column) -> Column:
    """too many requests, a server error or a named transport error."""
    return F.coalesce((status == 429) | (status >= 500), F.lit(False)) | F.coalesce(name.isin(*TRANSPORT_ERRORS), F.lit(False))


def event_tables(events: DataFrame, kind: str) -> dict[str, DataFrame]:
    """raw rows, events proper, and all that is not raw."""
    raw = F.col(kind) == "RAW"
    return {"raw": events.where(raw), "events": events.where(~raw & ~F.col(kind).isin(*TRANSFERS)), "extra": events.where(~raw)}


def segment_flags(matched: Column, shortest: int) -> Column:
    """whether a segment is long enough to go on, and whether any of its detections has no match."""
    return F.struct((F.size(matched) >= shortest).alias("propagable"), F.exists(matched, lambda m: ~m).alias("unmatched"))


def attacking_team(players: DataFrame, balls: DataFrame, limit: float = 5.0) -> DataFrame:
    """Per video the team that most often stands nearest to the ball, at most ``limit`` away.

    players: video, frame, track_id, team, x, y, score (of a track's rows in a frame the best counts), pos;
    balls: video, frame, x, y. Of equal teams the one seen first wins.
    """
    once = best_row(players, ["video", "frame", "track_id"], [F.col("score").desc(), F.col("pos").asc()])
    at = F.struct("video", "frame")
    points = balls.select(at.alias("point_key"), F.col("x").alias("bx"), F.col("y").alias("by"))
    there = once.select(at.alias("at"), "team", "x", "y", "pos").where("team is not null")
    met = nearest(points.withColumn("at", F.col("point_key")), there, "at", F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")), "pos", limit)
    votes = met.where("team is not null").groupBy("point_key.video", "team").agg(F.count("*").alias("n"), F.min("point_key.frame").alias("first"))
    return votes.groupBy("video").agg(F.max_by("team", F.struct("n", -F.col("first"))).alias("team"), F.max("n").alias("votes"))


def tracklets_of(segments: DataFrame, thing: str, segment: str, frame: str) -> DataFrame:
    """Each object's segments, detections and frame range."""
    return segments.groupBy(thing).agg(
        F.count_distinct(segment).alias("n_segments"), F.count("*").alias("n_detections"), F.min(frame).alias("first"), F.max(frame).alias("last")
    )


def subset(record: Column, fields: list[str]) -> Column:
    """A struct of some fields of another."""
    return F.struct(*(record[f].alias(f) for f in fields))


def rendered(rows: DataFrame, formats: dict[str, str], names: dict[str, str] | None = None) -> DataFrame:
    """Measures as text in their formats, under their display names."""
    shown = [F.format_string(formats[c], c).alias(c) if c in formats else F.col(c) for c in rows.columns]
    return rows.select(*shown).withColumnsRenamed(names or {})


def frame_annotations(frames: DataFrame, annotations: DataFrame, frame: str, order: str) -> DataFrame:
    """Each frame with its annotations as a list in order; a frame without any has an empty one."""
    rest = [c for c in annotations.columns if c != frame]
    per = annotations.groupBy(frame).agg(F.sort_array(F.collect_list(F.struct(order, *(c for c in rest if c != order)))).alias("annotations"))
    return frames.join(per, frame, "left").withColumn("annotations", F.coalesce("annotations", F.array().cast(per.schema["annotations"].dataType)))


def remembered(features: DataFrame, active: DataFrame, track: str, order: str, budget: int) -> DataFrame:
    """The last ``budget`` features of each track that is still active."""
    return top_k(features.join(active.select(track), track, "left_semi"), [track], [F.col(order).desc()], budget)


def caption_rows(datasets: dict[str, DataFrame], key: str, text: str, root: str) -> DataFrame:
    """Several caption sets in one table, with their paths and whether they have a text."""
    union = None
    for name, rows in datasets.items():
        path = F.concat_ws("/", F.lit(root), F.lit(name), F.col(key).cast("string"))
        here = rows.select(F.lit(name).alias("dataset"), key, text, path.alias("path"), (F.length(F.trim(F.coalesce(text, F.lit("")))) > 0).alias("has_text"))
        union = here if union is None else union.unionByName(here)
    return union


def legacy_events(labels: DataFrame, analyses: DataFrame, label: str, spans: str) -> DataFrame:
    """Old analyses joined to labels; their spans become events numbered from 1 within the label."""
    joined = labels.join(analyses, label, "left")
    return joined.select(label, F.posexplode_outer(spans).alias("k", "span")).select(label, (F.col("k") + 1).alias("event_no"), "span.*")


def named_lines(points: Column, lines: dict[str, list[int]]) -> Column:
    """Map of keypoint ids to points into a map of line names to their points in order; lines without any go."""
    literal = F.create_map(*(x for name, ids in lines.items() for x in (F.lit(name), F.array(*(F.lit(i) for i in ids)))))
    found = F.transform_values(literal, lambda _, ids: F.transform(F.filter(ids, lambda i: F.map_contains_key(points, i)), lambda i: F.element_at(points, i)))
    return F.map_filter(found, lambda _, some: F.size(some) > 0)


def ocr_box(corners: Column, crop: Column) -> Column:
    """A reading's corners (arrays of two, clockwise from the upper left) inside an ltwh crop as ltwh.

    Width and height are the differences of the second and first coordinates, as the readers give them.
    """
    return F.array(crop[0] + corners[0][0], crop[1] + corners[0][1], corners[1][1] - corners[0][1], corners[3][0] - corners[0][0])


def annotation_score(width: Column, height: Column, x: Column, y: Column) -> Column:
    """Rows with a place on the pitch before others, then by image area."""
    area = F.coalesce(width, F.lit(0.0)) * F.coalesce(height, F.lit(0.0))
    return F.struct((x.isNotNull() & y.isNotNull()).cast("int").alias("has_pitch"), area.alias("area"))
