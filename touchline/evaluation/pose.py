"""Pose precision by joint: assignment by matched joints, then AP for each joint and for groups.

truth has frame, gt_id, points (an array of structs x, y, one for each joint) and head, the size of the
head; predicted has frame, pred_id and points with x, y, c. A joint is there where x and y are above 0.
A predicted joint matches a true one within a share of the head. A predicted pose looks at the truth of
which it matches most joints, and a truth takes the best of those that look at it; of equal ones the
lower id. All joints of poses that no truth takes are false, and so are joints that miss.

All joints are scored in one plan: scores are ranked by joint in ranges, so no joint is one task.
Equal scores are ordered by frame and pose.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import frames as in_frames
from ..operators import ranking
from ..session import stored

#: Joints by their usual places, and the groups that are reported: fixed values.
GROUPS = {"Head": [2, 1, 0], "Shou": [3, 4], "Elb": [5, 6], "Wri": [7, 8], "Hip": [9, 10], "Knee": [11, 12], "Ankl": [14, 13]}
JOINTS = 15
#: Pairs of poses that are compared at once.
PAIRS = 100_000


def _there(p: Column) -> Column:
    return F.coalesce((p["x"] > 0) & (p["y"] > 0), F.lit(False))


def _flat(poses: DataFrame, key: str, truth: bool) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    return poses.select(
        "frame", F.lit(truth).alias("truth"), F.col(key).cast("long").alias("id"), F.col("points.x").cast("array<double>").alias("x"), F.col("points.y").cast("array<double>").alias("y"),
        (null("array<double>") if truth else F.col("points.c").cast("array<double>")).alias("c"), (F.col("head").cast("double") if truth else null("double")).alias("head"),
    )


def _padded(values: pd.Series, width: int) -> np.ndarray:
    out = np.full((len(values), width), np.nan)
    for k, v in enumerate(values):
        if v is not None:
            out[k, : len(v)] = v
    return out


def _taken(pdf: pd.DataFrame, firsts: np.ndarray, x: np.ndarray, y: np.ndarray, within: float) -> tuple[np.ndarray, ...]:
    """(truth, prediction, hits, share) of the poses that truths take, as places of rows; the rows are those of many whole frames."""
    there = (x > 0) & (y > 0)
    group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(pdf))))
    real, ids, head = pdf["truth"].to_numpy(bool), pdf["id"].to_numpy(np.int64), pdf["head"].to_numpy(float)
    known = pdf["frame"].notna().to_numpy()
    g, p = np.flatnonzero(real & known), np.flatnonzero(~real & known)
    begin, end = np.searchsorted(group[p], group[g]), np.searchsorted(group[p], group[g], side="right")
    found = []
    for rows in np.split(np.arange(len(g)), np.flatnonzero(np.diff(np.cumsum(end - begin) // PAIRS)) + 1):
        n = (end - begin)[rows]
        a = np.repeat(g[rows], n)
        b = p[np.repeat(begin[rows], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)]
        hits = there[a] & there[b] & (np.hypot(x[a] - x[b], y[a] - y[b]) <= (within * head[a])[:, None])
        some = hits.any(axis=1)
        found.append((a[some], b[some], hits[some]))
    a, b, hits = (np.concatenate(c) for c in zip(*found, strict=True))
    share = hits.sum(axis=1) / np.maximum(there[a].sum(axis=1), 1)
    # each prediction looks at one truth, then each truth takes one of those that look at it
    looks = np.lexsort([ids[a], -share, b])
    looks = looks[np.flatnonzero(np.diff(b[looks], prepend=-1))]
    takes = looks[np.lexsort([ids[b[looks]], -share[looks], a[looks]])]
    takes = takes[np.flatnonzero(np.diff(a[takes], prepend=-1))]
    return a[takes], b[takes], hits[takes], share[takes]


def _by_frames(truth: DataFrame, predicted: DataFrame, within: float, out: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    rows = _flat(truth, "gt_id", True).unionByName(_flat(predicted, "pred_id", False))

    def fold(pdf: pd.DataFrame, firsts: np.ndarray) -> pd.DataFrame:
        width = max(1, int(pdf["x"].map(lambda v: 0 if v is None else len(v)).max()))
        x, y = _padded(pdf["x"], width), _padded(pdf["y"], width)
        return out(pdf, x, y, *_taken(pdf, firsts, x, y, within))

    return in_frames.by_group(rows, ["frame"], fold, schema)


def pose_matches(truth: DataFrame, predicted: DataFrame, within: float = 0.5) -> DataFrame:
    """frame, gt_id, pred_id, hits (for each joint whether it matches), share (of the truth's joints) for the poses that truths take."""

    def matches(pdf: pd.DataFrame, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, hits: np.ndarray, share: np.ndarray) -> pd.DataFrame:
        frame, ids, sizes = pdf["frame"].to_numpy()[a], pdf["id"].to_numpy(), pdf["x"].map(len).to_numpy()[a]
        return pd.DataFrame({"frame": frame, "gt_id": ids[a], "pred_id": ids[b], "hits": pd.Series([h[:n].tolist() for h, n in zip(hits, sizes, strict=True)], dtype=object), "share": share})

    return _by_frames(truth, predicted, within, matches, f"frame {dict(truth.dtypes)['frame']}, gt_id long, pred_id long, hits array<boolean>, share double")


def judged_joints(truth: DataFrame, predicted: DataFrame, within: float = 0.5) -> DataFrame:
    """frame, pred_id, joint, score, hit for every joint that a predicted pose has."""

    def judged(pdf: pd.DataFrame, x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, hits: np.ndarray, share: np.ndarray) -> pd.DataFrame:
        met = np.zeros(x.shape, bool)
        met[b] = hits
        row, joint = np.nonzero((x > 0) & (y > 0) & ~pdf["truth"].to_numpy(bool)[:, None])
        score = _padded(pdf["c"], x.shape[1])[row, joint]
        return pd.DataFrame({"frame": pdf["frame"].to_numpy()[row], "pred_id": pdf["id"].to_numpy()[row], "joint": joint, "score": score, "hit": met[row, joint]})

    return _by_frames(truth, predicted, within, judged, f"frame {dict(predicted.dtypes)['frame']}, pred_id long, joint int, score double, hit boolean")


def joint_precision(judged: DataFrame, truth: DataFrame, joints: int = JOINTS) -> DataFrame:
    """joint, ap, precision, recall in hundredths, n_truth, n_predicted for each of ``joints``; without predictions all are 0."""
    real = truth.select(F.posexplode("points").alias("joint", "p")).where(_there(F.col("p"))).groupBy("joint").agg(F.count("*").alias("n_truth"))
    rows = judged.join(F.broadcast(real), "joint", "left").withColumn("n", F.greatest(F.coalesce("n_truth", F.lit(0)), F.lit(1))).drop("n_truth")
    curve = ranking.precision_recall(rows.withColumn("tie", F.struct("frame", "pred_id")), "score", F.col("hit"), "tie", "joint", "frame")
    curve = curve.withColumn("recall", F.col("tp") / F.col("n"))
    area = ranking.stepwise_ap(curve.where("hit").select("joint", "recall", "precision"), "joint")  # recall rises, and precision is best, at a hit
    ends = rows.groupBy("joint").agg(F.count("*").alias("n_predicted"), (F.count_if("hit") / F.count("*")).alias("precision"), (F.count_if("hit") / F.max("n")).alias("recall"))
    grid = judged.sparkSession.range(joints).select(F.col("id").cast("int").alias("joint"))
    full = grid.join(area, "joint", "left").join(ends, "joint", "left").join(real, "joint", "left")
    hundred = lambda c: (100 * F.coalesce(c, F.lit(0.0))).alias(c)
    return full.select("joint", hundred("ap"), hundred("precision"), hundred("recall"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_truth", "n_predicted")))


def pose_precision(truth: DataFrame, predicted: DataFrame, within: float = 0.5, groups: dict[str, list[int]] | None = None, joints: int = JOINTS) -> DataFrame:
    """Part, ap, precision, recall: the means over the joints of each group, and over all as 'Total'."""
    per = joint_precision(stored(judged_joints(truth, predicted, within)), truth, joints)
    parts = {**(groups or GROUPS), "Total": list(range(joints))}
    named = F.array(*(F.when(F.col("joint").isin(members), F.lit(name)) for name, members in parts.items()))
    each = per.withColumn("part", F.explode(F.filter(named, lambda n: n.isNotNull())))
    return each.groupBy("part").agg(*(F.avg(c).alias(c) for c in ("ap", "precision", "recall")))
