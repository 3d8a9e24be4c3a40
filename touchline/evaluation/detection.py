"""Detection scores: greedy matches, average precision, attribute accuracy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..operators import frames as in_frames
from ..operators import ordered, ranking
from ..session import stored
from .assignment import assign
from .track_precision import RECALLS, best_precisions

THRESHOLDS = [0.01, 0.25, *(round(0.5 + 0.05 * k, 2) for k in range(10))]


def _taken(pairs: DataFrame, pred: DataFrame, thresholds: list[float], marks: bool) -> DataFrame:
    """``greedy_matches``, or with ``marks`` a row for each prediction: for each threshold 1 where it takes a truth, else 2.

    Many frames are matched in a call, one prediction of each at a time.
    """
    kind = dict(pred.dtypes)["pos"]
    real = pairs.where(F.col("gt_id").isNotNull() & (F.col("iou") >= min(thresholds)))
    rows = pred.select("frame", "pred_id", "pos", F.lit(0).cast("long").alias("gt_id"), F.lit(0.0).alias("iou"), F.lit(False).alias("pair")).unionByName(
        real.select("frame", "pred_id", F.lit(0).cast(kind).alias("pos"), F.col("gt_id").cast("long").alias("gt_id"), "iou", F.lit(True).alias("pair"))
    )
    levels = np.array(thresholds)

    def take(pdf: pd.DataFrame, firsts: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(pdf))))
        pair = pdf["pair"].to_numpy(bool)
        name = np.unique(pdf["pred_id"].to_numpy(), return_inverse=True)[1]
        key = group * (int(name.max()) + 1) + name
        one = np.flatnonzero(~pair)
        one = one[np.lexsort([name[one], pdf["pos"].to_numpy()[one], group[one]])]
        one = one[np.sort(np.unique(key[one], return_index=True)[1])]  # a prediction comes once
        place = np.arange(len(one)) - np.searchsorted(group[one], group[one])
        by_key = np.argsort(key[one])
        at = np.flatnonzero(pair)
        found = np.searchsorted(key[one], key[at], sorter=by_key)
        known = found < len(one)
        known[known] = key[one][by_key[found[known]]] == key[at[known]]
        at, who = at[known], by_key[found[known]]
        gt, iou = pdf["gt_id"].to_numpy(np.int64)[at], pdf["iou"].to_numpy(float)[at]
        truth = np.unique(gt, return_inverse=True)[1]
        # of a prediction's pairs the last that is free is the best, the first truth of equals
        order = np.lexsort([-truth, iou, who, place[who]])
        who, gt, iou, truth = who[order], gt[order], iou[order], truth[order] + group[at[order]] * (len(at) + 1)
        truth = np.unique(truth, return_inverse=True)[1]
        free = np.ones((len(truth), len(levels)), bool)
        hit, took = np.zeros((len(one), len(levels)), bool), np.zeros((len(one), len(levels)), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(place[who])) + 1), len(who)] if len(who) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            worth = np.where(free[truth[a:b]] & (iou[a:b, None] >= levels), np.arange(1, b - a + 1)[:, None], 0)
            best = np.maximum.reduceat(worth, np.flatnonzero(np.diff(who[a:b], prepend=-1)))
            p, t = np.nonzero(best)
            got = a + best[p, t] - 1
            free[truth[got], t], hit[who[got], t], took[who[got], t] = False, True, gt[got]
        frame, pred_id = pdf["frame"].to_numpy()[one], pdf["pred_id"].to_numpy()[one]
        if marks:
            return pd.DataFrame({"frame": frame, "pred_id": pred_id, "marks": list(np.where(hit, 1, 2).astype(np.int8))})
        n = len(levels)
        found = pd.Series(took.ravel(), dtype="Int64").mask(~hit.ravel())
        return pd.DataFrame({"frame": np.repeat(frame, n), "threshold": np.tile(levels, len(one)), "pred_id": np.repeat(pred_id, n), "gt_id": found})

    return in_frames.by_group(rows, ["frame"], take, "frame long, pred_id long, marks array<tinyint>" if marks else "frame long, threshold double, pred_id long, gt_id long")


def greedy_matches(pairs: DataFrame, pred: DataFrame, thresholds: list[float]) -> DataFrame:
    """For every prediction and threshold the truth that it takes, or null.

    pairs(frame, pred_id, gt_id, iou); pred(frame, pred_id, pos): stored order decides who takes first.
    """
    return _taken(pairs, pred, thresholds, False)


def box_precision(pairs: DataFrame, pred: DataFrame, truths: int, thresholds: list[float]) -> DataFrame:
    """``average_precision`` of the ``greedy_matches`` of pred(frame, pred_id, pos, score), from one row for each prediction."""
    rows = stored(_taken(pairs, pred, thresholds, True).join(pred.select("frame", "pred_id", "score"), ["frame", "pred_id"]))
    n = rows.sparkSession.range(len(thresholds)).select(F.col("id").cast("int").alias("cell"), F.lit(max(1, truths)).cast("long").alias("n_truth"))
    best, counted = best_precisions(rows, "score", ["frame", "pred_id"], n, spread="frame", eps=0.0)
    per = best.groupBy("cell").agg((F.sum("p") / (RECALLS + 1)).alias("ap"))
    return counted.join(per, "cell", "left").select(F.get(F.array(*map(F.lit, thresholds)), F.col("cell")).alias("threshold"), F.coalesce("ap", F.lit(0.0)).alias("ap"))


def average_precision(matches: DataFrame, scores: DataFrame, truths: int, levels: int = 101) -> DataFrame:
    """Per threshold the interpolated AP; scores(frame, pred_id, score)."""
    rows = matches.join(scores, ["frame", "pred_id"]).withColumn("tie", F.struct("frame", "pred_id")).withColumn("hit", F.col("gt_id").isNotNull())
    curve = ranking.precision_recall(rows, "score", F.col("hit"), "tie", "threshold", "frame").withColumn("recall", F.col("tp") / F.lit(max(1, truths)))
    grid = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    reach = curve.withColumn("level", F.floor(F.col("recall") * (levels - 1) + F.lit(1e-9)).cast("int")).groupBy("threshold", "level").agg(F.max("precision").alias("p"))
    full = matches.select("threshold").distinct().withColumn("at", grid)
    best = full.join(reach.withColumnRenamed("threshold", "th"), (F.col("threshold") == F.col("th")) & (F.col("level") >= F.col("at")), "left")
    per = best.groupBy("threshold", "at").agg(F.coalesce(F.max("p"), F.lit(0.0)).alias("p"))
    return per.groupBy("threshold").agg(F.avg("p").alias("ap"))


def attribute_accuracy(matches: DataFrame, pred: DataFrame, truth: DataFrame, attributes: list[str]) -> DataFrame:
    """Per threshold, of matched predictions that state an attribute, the share that is right."""
    p = pred.select("frame", "pred_id", *(F.col(a).alias(f"p_{a}") for a in attributes))
    g = truth.select("frame", "gt_id", *(F.col(a).alias(f"g_{a}") for a in attributes))
    both = matches.where("gt_id is not null").join(p, ["frame", "pred_id"]).join(g, ["frame", "gt_id"])
    share = lambda a: F.try_divide(F.count_if(F.col(f"p_{a}") == F.col(f"g_{a}")).cast("double"), F.count(f"p_{a}")).alias(a)
    return both.groupBy("threshold").agg(*map(share, attributes))


def role_accuracy(matches: DataFrame, pred: DataFrame, truth: DataFrame, roles: list[str]) -> DataFrame:
    """The share of right roles by true role."""
    both = matches.where("gt_id is not null").join(pred.select("frame", "pred_id", F.col("role").alias("said")), ["frame", "pred_id"])
    both = both.join(truth.select("frame", "gt_id", "role"), ["frame", "gt_id"])
    return both.groupBy("threshold").pivot("role", roles).agg(F.avg((F.col("said") == F.col("role")).cast("int")))


def ignored_in_range(area: Column, duration: Column, areas: tuple[float, float], durations: tuple[float, float], crowd: Column) -> Column:
    """Rows that a range evaluation leaves out."""
    eps = 1e-9
    return ~(area.between(areas[0] - eps, areas[1] + eps) & duration.between(durations[0] - eps, durations[1] + eps)) | F.coalesce(crowd, F.lit(False))


def threshold_accuracy(points: DataFrame, image: str, distance: str, confidence: str, limit: float, least: float, cut: float) -> DataFrame:
    """Per image the counts of keypoints, then mean accuracy and the share of images above ``cut``."""
    said, near = F.coalesce(F.col(confidence) >= least, F.lit(False)), F.coalesce(F.col(distance) <= limit, F.lit(False))
    real = F.col(distance).isNotNull()
    per = points.groupBy(image).agg(F.count_if(said & near).alias("tp"), F.count_if(said & ~near).alias("fp"), F.count_if(real & ~(said & near)).alias("fn"))
    acc = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return per.agg(F.avg(acc).alias("accuracy"), F.avg((acc > cut).cast("int")).alias("share_above"))


def set_matches(predicted: DataFrame, targets: DataFrame, w_class: float = 1.0, w_box: float = 1.0, w_overlap: float = 1.0, alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """Sample, pred_id, target_id, cost: the assignment of least summed cost within each sample.

    predicted: sample, pred_id, logits (array<double>), box (array of centre x, centre y, width, height);
    targets: sample, target_id, label (place in the logits), box. The cost is a focal cost of the class, the
    summed distance of the four numbers, and the negative generalised IoU. Costs are made by Spark in one
    join by sample; a sample's pairs, its predictions times its targets, are one group.
    """
    p = predicted.select("sample", "pred_id", "logits", F.col("box").alias("a"))
    both = p.join(targets.select("sample", "target_id", "label", F.col("box").alias("b")), "sample")
    s = 1 / (1 + F.exp(-F.get("logits", F.col("label"))))
    focal = alpha * F.pow(1 - s, F.lit(gamma)) * -F.log(s + 1e-8) - (1 - alpha) * F.pow(s, F.lit(gamma)) * -F.log(1 - s + 1e-8)
    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, v: t + v)
    cost = w_class * focal + w_box * apart - w_overlap * boxes.giou(boxes.xywh_to_ltrb(F.col("a")), boxes.xywh_to_ltrb(F.col("b")))
    rows = both.select("sample", "pred_id", "target_id", cost.alias("cost"))
    kind = dict(predicted.dtypes)["sample"]

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        a, ai = np.unique(pdf["pred_id"], return_inverse=True)
        b, bi = np.unique(pdf["target_id"], return_inverse=True)
        m = np.full((len(a), len(b)), np.nan)
        m[ai, bi] = pdf["cost"]
        r, c = assign(m)
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "pred_id": a[r], "target_id": b[c], "cost": m[r, c]})

    return rows.groupBy("sample").applyInPandas(best, f"sample {kind}, pred_id long, target_id long, cost double")


def assigned_pairs(costs: DataFrame, keys: list[str], a: str, b: str, cost: str, limit: float, age: str | None = None) -> DataFrame:
    """Keys, a, b, cost of the assignment of least cost among pairs within ``limit``, group by group; with nulls, the a and b that got none.

    With ``age``, a column of the a side, younger ones choose first: a cascade of assignments by rising age.
    A pair that is not listed does not exist; a group's pairs are one task.
    """
    kinds = dict(costs.dtypes)
    columns = [*keys, a, b, cost, *([age] if age else [])]

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        out, free = [], sorted(pdf[b].unique())
        for _, level in pdf.groupby(age) if age else [(0, pdf)]:
            names = sorted(level[a].unique())
            some = level[level[b].isin(free) & (level[cost] <= limit)]
            m = np.full((len(names), len(free)), np.nan)
            m[np.searchsorted(names, some[a]), np.searchsorted(free, some[b])] = some[cost]
            pairs = {names[i]: (free[j], m[i, j]) for i, j in zip(*assign(m), strict=True)}
            out += [(n, *pairs.get(n, (None, None))) for n in names]
            free = [f for f in free if f not in {p[0] for p in pairs.values()}]
        out += [(None, f, None) for f in free]
        done = pd.DataFrame(out, columns=[a, b, cost]).astype({a: "Int64", b: "Int64", cost: float})
        return done.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, a, b, cost]]

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{a}` long, `{b}` long, `{cost}` double"])
    return costs.select(*columns).groupBy(*keys).applyInPandas(best, schema)


def box_map(pred: DataFrame, truth: DataFrame, images: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """category_id, threshold, ap of boxes over labelled images that have truth; ignored predictions are left out.

    pred: image_id, pred_id, category_id, score, box (ltrb), ignored; truth: image_id, gt_id, category_id, box; images: image_id, is_labeled.
    """
    used = images.where("is_labeled").join(truth.select("image_id").distinct(), "image_id").select("image_id")
    frames = ordered.numbered(used, ["image_id"], "frame")
    p = pred.where(~F.coalesce(F.col("ignored"), F.lit(False))).join(frames, "image_id").withColumn("pos", -F.col("score"))
    g = truth.join(frames, "image_id")
    out = None
    for row in g.select("category_id").distinct().orderBy("category_id").collect():  # a few classes
        c = row["category_id"]
        own_p, own_g = p.where(F.col("category_id").eqNullSafe(c)), g.where(F.col("category_id").eqNullSafe(c))
        pairs = own_p.select("frame", "pred_id", F.col("box").alias("a")).join(own_g.select("frame", "gt_id", F.col("box").alias("b")), "frame")
        matches = greedy_matches(pairs.select("frame", "pred_id", "gt_id", boxes.iou(F.col("a"), F.col("b")).alias("iou")), own_p.select("frame", "pred_id", "pos"), thresholds or THRESHOLDS[2:])
        per = average_precision(matches, own_p.select("frame", "pred_id", "score"), own_g.count()).select(F.lit(c).alias("category_id"), "threshold", "ap")
        out = per if out is None else out.unionByName(per)
    return out if out is not None else p.select("category_id", F.lit(0.0).alias("threshold"), F.lit(0.0).alias("ap")).limit(0)
