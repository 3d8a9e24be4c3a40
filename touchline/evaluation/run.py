"""An evaluation run: several metrics over one export, faults kept as rows.

gt and pred are tables of tracker (pred only), seq, t, an id and a box; every tracker meets every
sequence of the truth. A sequence whose rows break a rule for a tracker gives rows of faults in place
of results; all others are evaluated together, each metric in one plan for all trackers and
sequences. Results are one long table, with combined rows made from the sums of the sequences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from . import tracking

COMBINED = "COMBINED"
#: name: (by sequence, combined over sequences by keys).
METRICS: dict[str, tuple[Callable[[DataFrame, DataFrame, DataFrame], DataFrame], Callable[[DataFrame, list[str]], DataFrame]]] = {
    "HOTA": (tracking.hota, tracking.combined_hota),
    "CLEAR": (tracking.clear, tracking.combined_clear),
    "Identity": (tracking.identity, lambda per, keys: tracking.final_identity(per.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("idtp", "idfn", "idfp"))), keys)),
    "Count": (
        lambda sim, gt, pred: tracking.counts(gt, pred),
        lambda per, keys: per.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("frames", "gt_dets", "gt_ids", "dets", "ids"))),
    ),
}


def selected(rows: DataFrame, needed: Iterable[str], ignored: str | None = None, points: str | None = None, least_points: int = 1, track: str | None = None, least_rows: int = 1) -> DataFrame:
    """rows that are evaluated: nothing needed is null, not ignored, enough visible keypoints (array of structs with c), tracks not too short.

    Rows of a track are counted after the other rules; a row without a track is not short.
    """
    out = rows
    for c in needed:
        out = out.where(F.col(c).isNotNull())
    if ignored:
        out = out.where(~F.coalesce(F.col(ignored), F.lit(False)))
    if points:
        out = out.where(F.size(F.filter(points, lambda p: p["c"] > 0)) >= least_points)
    if track and least_rows > 1:
        short = out.where(F.col(track).isNotNull()).groupBy(track).agg(F.count("*").alias("__n")).where(F.col("__n") < least_rows)
        out = out.join(short.select(track), track, "left_anti")
    return out


def every(sequences: DataFrame, trackers: DataFrame) -> DataFrame:
    """Each sequence under each tracker, which is what a run evaluates."""
    names = trackers.groupBy().agg(F.collect_set("tracker").alias("__names"))  # a row of a few names
    return sequences.join(F.broadcast(names)).withColumn("tracker", F.explode("__names")).drop("__names")


def faults(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """tracker, seq, error: one row for each rule that a sequence breaks; a fault of the truth is one of every tracker.

    Rules: ids and frames are there, an id comes once in a frame, boxes have four finite edges in order,
    predictions belong to a sequence of the truth.
    """
    trackers = pred.select("tracker").where("tracker is not null").distinct()

    def rules(rows: DataFrame, keys: list[str], name: str, side: str) -> DataFrame:
        box = F.col("box")
        finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
        sound = F.coalesce((F.size(box) == 4) & finite(box[0]) & finite(box[1]) & finite(box[2]) & finite(box[3]) & (box[2] >= box[0]) & (box[3] >= box[1]), F.lit(False))
        broken = rows.groupBy(*keys).agg(
            F.count_if(F.col(name).isNull() | F.col("t").isNull()).alias("missing"), F.count_if(~sound).alias("boxes"), F.count("*").alias("n"),
        )
        twice = rows.where(F.col(name).isNotNull()).groupBy(*keys, "t", name).agg(F.count("*").alias("k")).where("k > 1").groupBy(*keys).agg(F.count("*").alias("twice"))
        full = broken.join(twice, keys, "left")
        said = F.array(
            F.when(F.col("missing") > 0, F.format_string(f"{side}: %d rows without an id or a frame", "missing")), F.when(F.col("boxes") > 0, F.format_string(f"{side}: %d broken boxes", "boxes")),
            F.when(F.col("twice") > 0, F.format_string(f"{side}: %d ids more than once in a frame", "twice")),
        )
        return full.select(*keys, F.explode(F.filter(said, lambda x: x.isNotNull())).alias("error"))

    of_truth = every(rules(gt, ["seq"], "gt_id", "truth"), trackers)
    of_pred = rules(pred.where("tracker is not null"), ["tracker", "seq"], "tracker_id", "predictions")
    strange = pred.where("tracker is not null").select("tracker", "seq").distinct().join(gt.select("seq").distinct(), "seq", "left_anti")
    strange = strange.select("tracker", "seq", F.lit("predictions: the truth has no such sequence").alias("error"))
    return of_truth.select("tracker", "seq", "error").unionByName(of_pred).unionByName(strange)


def evaluate(gt: DataFrame, pred: DataFrame, metrics: Iterable[str] = ("HOTA", "CLEAR", "Identity"), overlap: Callable[[Column, Column], Column] = boxes.iou) -> tuple[DataFrame, DataFrame]:
    """(results, errors).

    results has tracker, seq, metric, alpha, field, value, with seq 'COMBINED' over the sequences that
    could be evaluated; counts are always among them. errors has tracker, seq, error.
    """
    wanted = list(dict.fromkeys([*metrics, "Count"]))
    unknown = [m for m in wanted if m not in METRICS]
    if unknown:
        raise KeyError(f"unknown metrics: {', '.join(unknown)}")
    errors = faults(gt, pred)
    trackers = pred.select("tracker").where("tracker is not null").distinct()
    runs = every(gt.select("seq").distinct(), trackers)
    runs = runs.join(errors.select("tracker", "seq").distinct(), ["tracker", "seq"], "left_anti")
    # a run is one sequence of one tracker for the metrics, which know sequences only
    named = F.to_json(F.array(F.col("tracker").cast("string"), F.col("seq").cast("string")))
    runs = runs.withColumn("run", named)
    g = gt.join(runs, "seq").select(F.col("run").alias("seq"), "t", "gt_id", F.col("box").alias("a"))
    p = pred.join(runs, ["tracker", "seq"]).select(F.col("run").alias("seq"), "t", "tracker_id", F.col("box").alias("b"))
    sim = g.join(p, ["seq", "t"]).select("seq", "t", "gt_id", "tracker_id", overlap(F.col("a"), F.col("b")).alias("sim")).where("sim > 0")
    g, p = g.drop("a"), p.drop("b")
    split = F.from_json("seq", "array<string>")
    out = None
    for name in wanted:
        by_seq, combine = METRICS[name]
        per = by_seq(sim, g, p)
        own = per.withColumn("tracker", split[0]).withColumn("seq", split[1])
        whole = combine(own.drop("seq"), ["tracker"]).withColumn("seq", F.lit(COMBINED))
        for part in (own, whole):
            fields = [c for c in part.columns if c not in ("tracker", "seq", "alpha")]
            pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in fields))
            alpha = F.col("alpha") if "alpha" in part.columns else F.lit(None)
            long = part.select("tracker", "seq", F.lit(name).alias("metric"), alpha.cast("double").alias("alpha"), F.explode(pairs).alias("z")).select("tracker", "seq", "metric", "alpha", "z.*")
            out = long if out is None else out.unionByName(long)
    return out, errors


def summary(results: DataFrame, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """Tracker and one column for each field of the combined rows; fields by alpha are averaged over them, in hundredths where they are shares."""
    fields = fields or {"HOTA": ["HOTA", "DetA", "AssA", "LocA"], "CLEAR": ["MOTA", "MOTP", "idsw"], "Identity": ["IDF1"], "Count": ["dets", "gt_dets"]}
    wanted = [f for names in fields.values() for f in names]
    rows = results.where(F.col("seq") == COMBINED).where(F.concat_ws(".", "metric", "field").isin([f"{m}.{f}" for m, names in fields.items() for f in names]))
    whole = {"idsw", "dets", "gt_dets"}
    per = rows.groupBy("tracker", "field").agg(F.avg("value").alias("v")).groupBy("tracker").pivot("field", wanted).agg(F.first("v"))
    return per.select("tracker", *((F.col(c) if c in whole else 100 * F.col(c)).alias(c) for c in wanted))
