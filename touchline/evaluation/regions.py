"""Region and boundary scores of tracks of masks.

truth and predicted are tables of seq, id, t, mask; images has seq, n_frames, h and w. Frames of a
sequence follow each other in one task, where their masks are cut into runs once and compared whole
batches of frames at once; what leaves it is a sum for each pair of tracks, not a row for each pair of
masks. Boundaries are compared for the assigned pairs only. A frame in which neither track has a pixel
counts as 1, as it is defined.

The assignment of a sequence takes the largest sum of mean overlaps and has to give every truth a
track while there are any: frames that both miss make all pairs count, so its matrix is dense, tracks
by truths of one sequence; it is made in the group from the pairs that share a frame.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import masks
from ..operators import frames as in_frames
from ..operators.segments import shared_pixels
from .assignment import assign


def region_overlaps(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Seq, t, gt_id, tracker_id, j for the masks of a frame that share a pixel."""
    a, b = truth.select("seq", "t", F.col("id").alias("gt_id"), "mask"), predicted.select("seq", "t", F.col("id").alias("tracker_id"), "mask")
    common = shared_pixels(a, b, ["seq", "t"], "gt_id", "tracker_id")
    sized = common.join(a.select("seq", "t", "gt_id", masks.area(F.col("mask")).alias("x")), ["seq", "t", "gt_id"])
    sized = sized.join(b.select("seq", "t", "tracker_id", masks.area(F.col("mask")).alias("y")), ["seq", "t", "tracker_id"])
    return sized.select("seq", "t", "gt_id", "tracker_id", (F.col("common") / (F.col("x") + F.col("y") - F.col("common"))).alias("j"))


#: Pairs of masks of a frame that are made at once.
PAIRS = 1 << 20


def overlap_sums(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """seq, gt_id, tracker_id, v in parts to be added: of two tracks the frames in which both have pixels and their overlaps there.

    With a null on one side v is the number of frames in which a track has pixels; tracks without any come with 0.
    """
    side = lambda df, real: df.select("seq", "t", F.lit(real).alias("real"), F.col("id").cast("long").alias("id"), "mask")
    rows = side(truth, True).unionByName(side(predicted, False))

    def meet(many: pd.DataFrame, firsts: np.ndarray) -> pd.DataFrame:
        frame = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(many))))
        seq = pd.factorize(many["seq"], use_na_sentinel=False)[0]
        real, ids, n = many["real"].to_numpy(bool), many["id"].to_numpy(np.int64), len(many)
        table = masks.run_table(many["mask"].tolist())
        some = np.bincount(table[0], minlength=n) > 0
        g, p = np.flatnonzero(real & some), np.flatnonzero(~real & some)
        per = np.bincount(frame[p], minlength=len(firsts))
        begin, per = (np.cumsum(per) - per)[frame[g]], per[frame[g]]
        own = pd.DataFrame({"at": np.arange(n), "s": seq, "real": real, "id": ids, "v": some.astype(float)}).groupby(["s", "real", "id"], sort=False).agg({"at": "first", "v": "sum"}).reset_index()
        out = [pd.DataFrame({"at": own["at"], "gt_id": own["id"].astype("Int64").where(own["real"]), "tracker_id": own["id"].astype("Int64").mask(own["real"]), "v": own["v"]})]
        for k in np.split(np.arange(len(g)), np.flatnonzero(np.diff(np.cumsum(per) // PAIRS)) + 1):
            a = np.repeat(g[k], per[k])
            if len(a):
                b = p[np.repeat(begin[k], per[k]) + np.arange(len(a)) - np.repeat(np.cumsum(per[k]) - per[k], per[k])]
                v = 1 + masks.pair_overlaps(table, n, a, b)
                both = pd.DataFrame({"at": a, "s": seq[a], "gt_id": ids[a], "tracker_id": ids[b], "v": v}).groupby(["s", "gt_id", "tracker_id"], sort=False).agg({"at": "first", "v": "sum"})
                out.append(both.reset_index()[["at", "gt_id", "tracker_id", "v"]].astype({"gt_id": "Int64", "tracker_id": "Int64"}))
        found = pd.concat(out, ignore_index=True)
        return found.assign(seq=many["seq"].to_numpy()[found["at"]])[["seq", "gt_id", "tracker_id", "v"]]

    return in_frames.by_group(rows, ["seq", "t"], meet, f"seq {dict(truth.dtypes)['seq']}, gt_id long, tracker_id long, v double", together=["seq"])


def assigned(truth: DataFrame, predicted: DataFrame, images: DataFrame) -> DataFrame:
    """seq, gt_id, tracker_id: the best assignment by mean overlap; truths without a track have a null."""
    rows = overlap_sums(truth, predicted).join(images.select("seq", "n_frames"), "seq")
    kind = dict(truth.dtypes)["seq"]

    def best(many: pd.DataFrame, firsts: np.ndarray) -> pd.DataFrame:
        cuts = [*firsts, len(many)]
        columns = {c: many[c].to_numpy() for c in ("gt_id", "tracker_id", "v", "n_frames")}
        found = [matched({c: v[a:b] for c, v in columns.items()}) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        at = np.repeat(firsts, [len(f[0]) for f in found])
        return pd.DataFrame({"seq": many["seq"].to_numpy()[at], "gt_id": np.concatenate([f[0] for f in found]), "tracker_id": pd.array(np.concatenate([f[1] for f in found]), "Int64")})

    def matched(one: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n, no_gt, no_tr = one["n_frames"][0], pd.isna(one["gt_id"]), pd.isna(one["tracker_id"])
        (gt, by_g), (tr, by_p) = (np.unique(ids.astype(np.int64), return_inverse=True) for ids in (one["gt_id"][no_tr], one["tracker_id"][no_gt]))
        alone_g, alone_p = np.bincount(by_g, one["v"][no_tr], len(gt)), np.bincount(by_p, one["v"][no_gt], len(tr))
        # frames that both miss: all, less those of either, and those of both again, which the pairs bring
        m = n - alone_g[:, None] - alone_p[None, :]
        both = ~no_gt & ~no_tr
        np.add.at(m, (np.searchsorted(gt, one["gt_id"][both].astype(np.int64)), np.searchsorted(tr, one["tracker_id"][both].astype(np.int64))), one["v"][both])
        none = max(len(gt) - len(tr), 0)
        r, c = assign(-np.concatenate([m, np.repeat(n - alone_g[:, None], none, axis=1)], axis=1))
        real, took = c < len(tr), np.full(len(gt), -1)
        took[r[real]] = c[real]
        return gt, np.array([tr[k] if k >= 0 else pd.NA for k in took], object)

    return in_frames.by_group(rows, ["seq"], best, f"seq {kind}, gt_id long, tracker_id long")


def frame_scores(truth: DataFrame, predicted: DataFrame, images: DataFrame) -> DataFrame:
    """Seq, gt_id, t, j, f of every truth in every frame of its sequence against the track assigned to it."""
    grid = assigned(truth, predicted, images).join(images, "seq").withColumn("t", F.explode(F.when(F.col("n_frames") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1))))
    a = truth.select("seq", "t", F.col("id").alias("gt_id"), F.col("mask").alias("a"))
    b = predicted.select("seq", "t", F.col("id").alias("tracker_id"), F.col("mask").alias("b"))
    full = grid.join(a, ["seq", "t", "gt_id"], "left").join(b, ["seq", "t", "tracker_id"], "left")
    empty = lambda c: F.coalesce(masks.area(F.col(c)), F.lit(0)) == 0
    j = F.when(empty("a") & empty("b"), 1.0).when(empty("a") | empty("b"), 0.0).otherwise(masks.mask_iou("a", "b", "h", "w"))
    return full.select("seq", "gt_id", "tracker_id", "t", "n_frames", j.alias("j"), masks.boundary_score("a", "b", "h", "w").alias("f"))


def track_scores(frames: DataFrame) -> DataFrame:
    """Of each truth the mean, the share of frames above a half and the decay of j and f.

    The decay is the mean of the first quarter of the frames less that of the last; neighbouring quarters share a frame.
    """
    edge = lambda k: F.floor(1 + (F.col("n_frames") - 1) * (k / 4) + 0.5 + 1e-10) - 1
    first, last = F.col("t").between(edge(0), edge(1)), F.col("t").between(edge(3), edge(4))
    fields = []
    for c in ("j", "f"):
        fields += [F.avg(c).alias(f"{c}_mean"), F.avg((F.col(c) > 0.5 + np.finfo(float).eps).cast("double")).alias(f"{c}_recall")]
        fields.append((F.avg(F.when(first, F.col(c))) - F.avg(F.when(last, F.col(c)))).alias(f"{c}_decay"))
    return frames.groupBy("seq", "gt_id").agg(*fields)


FIELDS = [f"{c}_{k}" for c in "jf" for k in ("mean", "recall", "decay")]


def region_scores(truth: DataFrame, predicted: DataFrame, images: DataFrame) -> DataFrame:
    """Seq, n_tracks and the means of ``track_scores`` over the truths of each sequence."""
    per = track_scores(frame_scores(truth, predicted, images)).groupBy("seq").agg(F.count("*").alias("n_tracks"), *(F.avg(c).alias(c) for c in FIELDS))
    return per.withColumn("jf_mean", (F.col("j_mean") + F.col("f_mean")) / 2)


def combined_scores(per: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Over all sequences, weighed by their truths."""
    from .tracking import weighted_average

    fields = [*FIELDS, "jf_mean"]
    return per.groupBy(*(keys or [])).agg(F.sum("n_tracks").alias("n_tracks"), *(weighted_average(F.col(c), F.col("n_tracks")).alias(c) for c in fields))
