"""HOTA, CLEAR, identity, VACE and counts.

Inputs are long tables: gt(seq, t, gt_id), pred(seq, t, tracker_id) and sim(seq, t, gt_id, tracker_id,
sim) for pairs of one frame. Sums over pairs and sequences are plain aggregations; optimal matching
runs in functions that take many whole frames, and over a sequence only where the definition
looks at earlier frames. No table is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import frames as in_frames
from ..operators import ordered
from .assignment import assign, assign_sparse

ALPHAS = [round(0.05 * k, 2) for k in range(1, 20)]
_EPS = float(np.finfo(float).eps)


def alignment(sim: DataFrame, gt: DataFrame, pred: DataFrame, least: float = _EPS) -> DataFrame:
    """M01, first pass: seq, gt_id, tracker_id, potential, alignment (Jaccard of summed normalised similarity); sums up to ``least`` count as none."""
    rows = sim.groupBy("seq", "t", "gt_id").agg(F.sum("sim").alias("by_gt"))
    columns = sim.groupBy("seq", "t", "tracker_id").agg(F.sum("sim").alias("by_tr"))
    joined = sim.join(rows, ["seq", "t", "gt_id"]).join(columns, ["seq", "t", "tracker_id"])
    rest = F.col("by_gt") + F.col("by_tr") - F.col("sim")
    potential = joined.withColumn("p", F.when(rest > least, F.col("sim") / rest).otherwise(0.0)).groupBy("seq", "gt_id", "tracker_id").agg(F.sum("p").alias("potential"))
    g, t = gt.groupBy("seq", "gt_id").agg(F.count("*").alias("n_gt")), pred.groupBy("seq", "tracker_id").agg(F.count("*").alias("n_tr"))
    full = potential.join(g, ["seq", "gt_id"]).join(t, ["seq", "tracker_id"])
    return full.withColumn("alignment", F.col("potential") / (F.col("n_gt") + F.col("n_tr") - F.col("potential")))


def frame_matches(scored: DataFrame, score: str) -> DataFrame:
    """M01, second pass: the assignment of largest summed score within each frame; needs seq, t, gt_id, tracker_id, sim."""

    def fold(pdf: pd.DataFrame, firsts: np.ndarray) -> pd.DataFrame:
        gt, tr, worth = pdf["gt_id"].to_numpy(np.int64), pdf["tracker_id"].to_numpy(np.int64), pdf[score].to_numpy(float)
        sizes = np.diff(np.append(firsts, len(pdf)))
        keep = np.zeros(len(pdf), bool)
        alone = firsts[sizes == 1]
        keep[alone] = np.isfinite(worth[alone])
        for a, n in zip(firsts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            g, t, v = gt[a : a + n], tr[a : a + n], worth[a : a + n]
            one_g, one_t = (g == g[0]).all(), (t == t[0]).all()
            if (one_g or one_t) and np.isfinite(v).all():  # a matrix of one row or column: its best, of equal ones the lowest id
                best = np.flatnonzero(v == v.max())
                keep[a + best[np.argmin((t if one_g else g)[best])]] = True
                continue
            gi, ti = np.unique(g, return_inverse=True)[1], np.unique(t, return_inverse=True)[1]
            s, at = np.zeros((gi.max() + 1, ti.max() + 1)), np.full((gi.max() + 1, ti.max() + 1), -1)
            s[gi, ti], at[gi, ti] = v, np.arange(a, a + n)
            chosen = at[assign(-s)]
            keep[chosen[chosen >= 0]] = True
        return pdf.loc[keep, ["seq", "t", "gt_id", "tracker_id", "sim"]]

    kind = dict(scored.dtypes)["seq"]
    rows = scored.select("seq", "t", "gt_id", "tracker_id", "sim", *([score] if score != "sim" else []))
    return in_frames.by_group(rows, ["seq", "t"], fold, f"seq {kind}, t long, gt_id long, tracker_id long, sim double")


def hota(sim: DataFrame, gt: DataFrame, pred: DataFrame, alphas: list[float] | None = None) -> DataFrame:
    """Per sequence and alpha the counts and association sums, then the final fields."""
    align = alignment(sim, gt, pred)
    scored = sim.join(align.select("seq", "gt_id", "tracker_id", "alignment", "n_gt", "n_tr"), ["seq", "gt_id", "tracker_id"])
    matches = frame_matches(scored.withColumn("score", F.col("alignment") * F.col("sim")), "score")
    levels = F.filter(F.array(*map(F.lit, alphas or ALPHAS)), lambda a: F.col("sim") >= a - F.lit(_EPS))
    hits = matches.withColumn("alpha", F.explode(levels))
    per = hits.groupBy("seq", "alpha", "gt_id", "tracker_id").agg(F.count("*").alias("m"), F.sum("sim").alias("loc"))
    sized = per.join(align.select("seq", "gt_id", "tracker_id", "n_gt", "n_tr"), ["seq", "gt_id", "tracker_id"])
    m = F.col("m")
    sums = sized.groupBy("seq", "alpha").agg(
        F.sum("m").alias("tp"), F.sum("loc").alias("loc"), F.sum(m * m / (F.col("n_gt") + F.col("n_tr") - m)).alias("ass_a"),
        F.sum(m * m / F.col("n_gt")).alias("ass_re"), F.sum(m * m / F.col("n_tr")).alias("ass_pr"),
    )
    g, t = gt.groupBy("seq").agg(F.count("*").alias("gts")), pred.groupBy("seq").agg(F.count("*").alias("preds"))
    grid = g.join(t, "seq", "full_outer").withColumn("alpha", F.explode(F.array(*map(F.lit, alphas or ALPHAS))))
    full = grid.join(sums, ["seq", "alpha"], "left").na.fill(0)
    tp = F.col("tp")
    return final_hota(
        full.select(
            "seq", "alpha", tp.cast("long").alias("tp"), (F.col("gts") - tp).cast("long").alias("fn"), (F.col("preds") - tp).cast("long").alias("fp"),
            "loc", "ass_a", "ass_re", "ass_pr",
        ), ["seq", "alpha"],
    )


def final_hota(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Final fields of summed counts; association sums are weighted by matches already."""
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    one = lambda x: F.greatest(F.lit(1), x)
    tiny = F.lit(1e-10)
    ass = lambda c: F.col(c) / one(tp)
    det_a = tp / one(tp + fn + fp)
    return sums.select(
        *keys, "tp", "fn", "fp", "loc", "ass_a", "ass_re", "ass_pr", (F.greatest(tiny, F.col("loc")) / F.greatest(tiny, tp.cast("double"))).alias("LocA"),
        ass("ass_a").alias("AssA"), ass("ass_re").alias("AssRe"), ass("ass_pr").alias("AssPr"), (tp / one(tp + fn)).alias("DetRe"), (tp / one(tp + fp)).alias("DetPr"),
        det_a.alias("DetA"), F.sqrt(det_a * ass("ass_a")).alias("HOTA"), F.sqrt(tp / one(tp + fn) * ass("ass_a")).alias("OWTA"),
    )


def combined_hota(per: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Over all sequences, by alpha: sums of counts, match-weighted association and localisation."""
    keys = [*(keys or []), "alpha"]
    return final_hota(per.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tp", "fn", "fp", "loc", "ass_a", "ass_re", "ass_pr"))), keys)


def clear(sim: DataFrame, gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per sequence matches, switches, fragments and tracked shares; each frame continues the last one's matches.

    A sequence is folded in frame order; frames without truth or without predictions keep the memory.
    """
    left = gt.select("seq", "t", F.lit("g").alias("kind"), "gt_id", F.lit(None).cast("long").alias("tracker_id"), F.lit(None).cast("double").alias("sim"))
    right = pred.select("seq", "t", F.lit("p").alias("kind"), F.lit(None).cast("long").alias("gt_id"), "tracker_id", F.lit(None).cast("double").alias("sim"))
    pairs = sim.select("seq", "t", F.lit("s").alias("kind"), "gt_id", "tracker_id", "sim")
    kind = dict(gt.dtypes)["seq"]

    def step(state: dict, pdf: pd.DataFrame) -> None:
        last, previous, count, matched, starts, sums = (state[k] for k in ("last", "previous", "count", "matched", "starts", "sums"))
        state["seq"] = pdf["seq"].iloc[0]
        for _, f in pdf.groupby("t", sort=True):
            sums["frames"] += 1
            g = np.sort(f.loc[f["kind"] == "g", "gt_id"].to_numpy(np.int64))
            p = np.sort(f.loc[f["kind"] == "p", "tracker_id"].to_numpy(np.int64))
            for x in g:
                count[x] = count.get(x, 0) + 1
            if not len(g) or not len(p):
                sums["fp"] += len(p)
                sums["fn"] += len(g)
                continue
            s = f[f["kind"] == "s"]
            m = np.zeros((len(g), len(p)))
            m[np.searchsorted(g, s["gt_id"].to_numpy(np.int64)), np.searchsorted(p, s["tracker_id"].to_numpy(np.int64))] = s["sim"]
            may = m >= threshold - _EPS
            held = np.array([[previous.get(a) == b for b in p] for a in g])
            worth = np.where(may, m + 1000.0 * held, 0.0)  # a pair of the last frame outweighs every new one
            r, c = assign(-worth)
            good = worth[r, c] > _EPS
            now = {int(g[i]): int(p[j]) for i, j in zip(r[good], c[good], strict=True)}
            sums["idsw"] += sum(a in last and last[a] != b for a, b in now.items())
            for a in now:
                matched[a] = matched.get(a, 0) + 1
                starts[a] = starts.get(a, 0) + (a not in previous)
            last.update(now)
            previous.clear()
            previous.update(now)
            sums["tp"] += len(now)
            sums["fn"] += len(g) - len(now)
            sums["fp"] += len(p) - len(now)
            sums["motp_sum"] += float(m[r[good], c[good]].sum())

    def finish(state: dict) -> pd.DataFrame:
        count, sums = state["count"], state["sums"]
        share = [state["matched"].get(a, 0) / n for a, n in count.items()]
        mt, some = sum(x > 0.8 for x in share), sum(x >= 0.2 for x in share)
        own = {"seq": state["seq"], "mt": mt, "pt": some - mt, "ml": len(count) - some, "frag": sum(n - 1 for n in state["starts"].values())}
        return pd.DataFrame([own | sums])[names]

    def start() -> dict:
        return {k: {} for k in ("last", "previous", "count", "matched", "starts")} | {"sums": dict(tp=0, fn=0, fp=0, idsw=0, motp_sum=0.0, frames=0)}

    names = ["seq", "tp", "fn", "fp", "idsw", "mt", "pt", "ml", "frag", "motp_sum", "frames"]
    schema = f"seq {kind}, " + ", ".join(f"{n} {'double' if n == 'motp_sum' else 'long'}" for n in names[1:])
    rows = left.unionByName(right).unionByName(pairs)
    return final_clear(in_frames.fold(rows, "seq", "t", start, step, schema, finish), ["seq"])


def final_clear(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Final fields of summed counts."""
    tp, fn, fp, sw = (F.col(c) for c in ("tp", "fn", "fp", "idsw"))
    truth = F.greatest(F.lit(1.0), (tp + fn).cast("double"))
    safe = F.log10(F.greatest(F.lit(1.0), sw.cast("double")))
    return sums.select(
        *keys, "tp", "fn", "fp", "idsw", "mt", "pt", "ml", "frag", "motp_sum", "frames", ((tp - fp - sw) / truth).alias("MOTA"),
        (F.col("motp_sum") / F.greatest(F.lit(1.0), tp.cast("double"))).alias("MOTP"), ((tp - fp) / truth).alias("MODA"), ((F.col("motp_sum") - fp - sw) / truth).alias("sMOTA"),
        ((tp - fp - safe) / truth).alias("MOTAL"), (2 * tp / F.greatest(F.lit(1.0), (2 * tp + fn + fp).cast("double"))).alias("F1"),
        (fp / F.greatest(F.lit(1.0), F.col("frames").cast("double"))).alias("FP_per_frame"), (tp / truth).alias("Recall"),
        (tp / F.greatest(F.lit(1.0), (tp + fp).cast("double"))).alias("Precision"),
    )


def combined_clear(per: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Over all sequences."""
    fields = ("tp", "fn", "fp", "idsw", "mt", "pt", "ml", "frag", "motp_sum", "frames")
    return final_clear(per.groupBy(*(keys or [])).agg(*(F.sum(c).alias(c) for c in fields)), keys or [])


def pair_counts(sim: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Frames in which a truth and a prediction agree."""
    return sim.where(F.col("sim") >= threshold).groupBy("seq", "gt_id", "tracker_id").agg(F.countDistinct("t").alias("together"))


def identity(sim: DataFrame, gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per sequence IDTP, IDFN, IDFP and scores of the one best identity assignment."""
    g, t = gt.groupBy("seq").agg(F.count("*").alias("gts")), pred.groupBy("seq").agg(F.count("*").alias("preds"))
    kind = dict(gt.dtypes)["seq"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        # leaving both ids alone costs what matching saves: the best assignment has the most common frames
        best = assign_sparse(pdf["gt_id"], pdf["tracker_id"], pdf["together"].to_numpy())
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]], "idtp": [int(pdf["together"].to_numpy()[best].sum())]})

    best = pair_counts(sim, threshold).groupBy("seq").applyInPandas(fold, f"seq {kind}, idtp long")
    full = g.join(t, "seq", "full_outer").join(best, "seq", "left").na.fill(0)
    idtp = F.col("idtp")
    return final_identity(full.select("seq", "idtp", (F.col("gts") - idtp).alias("idfn"), (F.col("preds") - idtp).alias("idfp")), ["seq"])


def final_identity(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Recall, precision and F1 of identities."""
    tp, fn, fp = F.col("idtp"), F.col("idfn"), F.col("idfp")
    part = lambda a, b: a / F.greatest(F.lit(1.0), b.cast("double"))
    return sums.select(*keys, "idtp", "idfn", "idfp", part(tp, tp + fn).alias("IDR"), part(tp, tp + fp).alias("IDP"), part(tp, tp + 0.5 * fn + 0.5 * fp).alias("IDF1"))


def counts(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Detections and ids of both sides, and frames, per sequence."""
    g = gt.groupBy("seq").agg(F.count("*").alias("gt_dets"), F.countDistinct("gt_id").alias("gt_ids"))
    p = pred.groupBy("seq").agg(F.count("*").alias("dets"), F.countDistinct("tracker_id").alias("ids"))
    frames = gt.select("seq", "t").unionByName(pred.select("seq", "t")).groupBy("seq").agg(F.countDistinct("t").alias("frames"))
    return frames.join(g, "seq", "left").join(p, "seq", "left").na.fill(0)


def vace(sim: DataFrame, gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Spatio-temporal tracking accuracy by one assignment of temporal overlaps, and frame detection accuracy."""
    kind = dict(gt.dtypes)["seq"]
    g, t = gt.groupBy("seq", "gt_id").agg(F.countDistinct("t").alias("n_gt")), pred.groupBy("seq", "tracker_id").agg(F.countDistinct("t").alias("n_tr"))
    pairs = pair_counts(sim, threshold).join(g, ["seq", "gt_id"]).join(t, ["seq", "tracker_id"])
    overlap = pairs.withColumn("overlap", F.col("together") / (F.col("n_gt") + F.col("n_tr") - F.col("together")))

    def tracks(pdf: pd.DataFrame) -> pd.DataFrame:
        best = assign_sparse(pdf["gt_id"], pdf["tracker_id"], pdf["overlap"].to_numpy())
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]], "stda": [float(pdf["overlap"].to_numpy()[best].sum())]})

    stda = overlap.select("seq", "gt_id", "tracker_id", "overlap").groupBy("seq").applyInPandas(tracks, f"seq {kind}, stda double")
    ids = g.groupBy("seq").agg(F.count("*").alias("a")).join(t.groupBy("seq").agg(F.count("*").alias("b")), "seq", "full_outer")
    per_frame = gt.groupBy("seq", "t").agg(F.count("*").alias("x")).join(pred.groupBy("seq", "t").agg(F.count("*").alias("y")), ["seq", "t"], "full_outer").na.fill(0)
    best = frame_matches(sim.withColumn("score", F.col("sim")), "score").groupBy("seq", "t").agg(F.sum("sim").alias("s"))
    fda = per_frame.join(best, ["seq", "t"], "left").groupBy("seq").agg(
        F.sum(2 * F.coalesce("s", F.lit(0.0)) / (F.col("x") + F.col("y"))).alias("fda"), F.count("*").alias("frames")
    )
    full = ids.na.fill(0).join(stda, "seq", "left").join(fda, "seq", "left").na.fill(0)
    return full.select("seq", "stda", "fda", (2 * F.col("stda") / F.greatest(F.lit(1.0), (F.col("a") + F.col("b")).cast("double"))).alias("ATA"), (F.col("fda") / F.greatest(F.lit(1.0), F.col("frames").cast("double"))).alias("SFDA"))


def pitch_distance(matches: DataFrame, gt_at: DataFrame, pred_at: DataFrame, sigma: float = 2.0427) -> DataFrame:
    """Mean distance of matched positions (seq, t, id, x, y) and mean Gaussian similarity."""
    a = gt_at.select("seq", "t", F.col("id").alias("gt_id"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    b = pred_at.select("seq", "t", F.col("id").alias("tracker_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    d = F.hypot(F.col("gx") - F.col("px"), F.col("gy") - F.col("py"))
    both = matches.join(a, ["seq", "t", "gt_id"]).join(b, ["seq", "t", "tracker_id"])
    return both.groupBy("seq").agg(F.avg(d).alias("distance"), F.avg(F.exp(-d * d / (2 * sigma * sigma))).alias("similarity"))


def track_overlap(a: DataFrame, b: DataFrame, touching: bool = False) -> DataFrame:
    """Summed intersections over summed unions of two tracks' boxes over all frames of either.

    a and b have seq, id, t, box (ltrb); pairs share at least one frame or, with ``touching``, a part of one.
    """
    from ..functions import boxes

    size = lambda df, name: df.groupBy("seq", "id").agg(F.sum(boxes.area(F.col("box"))).alias(name))
    met = a.select("seq", "t", F.col("id").alias("a_id"), F.col("box").alias("x")).join(b.select("seq", "t", F.col("id").alias("b_id"), F.col("box").alias("y")), ["seq", "t"])
    part = boxes.intersection(F.col("x"), F.col("y"))
    common = (met.where(part > 0) if touching else met).groupBy("seq", "a_id", "b_id").agg(F.sum(part).alias("i"))
    full = common.join(size(a, "sa").withColumnRenamed("id", "a_id"), ["seq", "a_id"]).join(size(b, "sb").withColumnRenamed("id", "b_id"), ["seq", "b_id"])
    union = F.col("sa") + F.col("sb") - F.col("i")
    return full.select("seq", "a_id", "b_id", F.when(union > 0, F.col("i") / union).otherwise(0.0).alias("iou"))


# Event tables: seq, frame, type, oid, hid, distance.


def accumulate(pairs: DataFrame, objects: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """MATCH, SWITCH, MISS and FP events of each sequence in frame order.

    pairs(seq, frame, oid, hid, distance) holds the pairs that may match; earlier pairs are kept first,
    the rest is assigned at least cost; frames of either side count.
    """
    kind = dict(objects.dtypes)["seq"]
    null = lambda t: F.lit(None).cast(t)
    rows = (
        pairs.select("seq", "frame", "oid", "hid", "distance")
        .unionByName(objects.select("seq", "frame", "oid", null("long").alias("hid"), null("double").alias("distance")))
        .unionByName(hypotheses.select("seq", "frame", null("long").alias("oid"), "hid", null("double").alias("distance")))
    )

    def step(held: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        seq, out = pdf["seq"].iloc[0], []
        for frame, f in pdf.groupby("frame", sort=True):
            both = f[f["distance"].notna()]
            o = sorted(set(f["oid"].dropna().astype(int)))
            h = sorted(set(f["hid"].dropna().astype(int)))
            d = {(int(a), int(b)): float(c) for a, b, c in zip(both["oid"], both["hid"], both["distance"], strict=True)}
            met = {a: held[a] for a in o if held.get(a) in h and (a, held[a]) in d}
            kept = {}
            for a, b in met.items():  # the smaller object keeps a hypothesis that two held
                if b not in kept.values():
                    kept[a] = b
            out += [(seq, frame, "MATCH", a, b, d[a, b]) for a, b in kept.items()]
            free_o, free_h = [a for a in o if a not in kept], [b for b in h if b not in kept.values()]
            cost = np.array([[d.get((a, b), np.nan) for b in free_h] for a in free_o]).reshape(len(free_o), len(free_h))
            fresh = {free_o[i]: free_h[j] for i, j in zip(*assign(cost), strict=True)}
            out += [(seq, frame, "SWITCH" if a in held and held[a] != b else "MATCH", a, b, d[a, b]) for a, b in fresh.items()]
            held.update(fresh)
            out += [(seq, frame, "MISS", a, None, None) for a in free_o if a not in fresh]
            out += [(seq, frame, "FP", None, b, None) for b in free_h if b not in fresh.values()]
        return pd.DataFrame(out, columns=["seq", "frame", "type", "oid", "hid", "distance"]).astype({"oid": "Int64", "hid": "Int64"})

    return in_frames.fold(rows, "seq", "frame", dict, step, f"seq {kind}, frame long, type string, oid long, hid long, distance double")


def event_metrics(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counters by type, then MOTA, MOTP, precision and recall; null where a divisor is zero."""
    n = lambda *types: F.count_if(F.col("type").isin(*types))
    found = n("MATCH", "SWITCH")
    per = events.groupBy(*(keys or [])).agg(
        n("MATCH").alias("matches"), n("SWITCH").alias("switches"), n("MISS").alias("misses"), n("FP").alias("false_positives"),
        found.alias("detections"), n("MATCH", "SWITCH", "MISS").alias("objects"), n("MATCH", "SWITCH", "FP").alias("predictions"), F.sum("distance").alias("distance"),
    )
    share = lambda a, b: F.try_divide(a.cast("double"), b)
    c = F.col
    return per.select(
        *(keys or []), "matches", "switches", "misses", "false_positives", "objects", "predictions",
        (1 - share(c("misses") + c("switches") + c("false_positives"), c("objects"))).alias("mota"), share(c("distance"), c("detections")).alias("motp"),
        share(c("detections"), c("detections") + c("false_positives")).alias("precision"), share(c("detections"), c("objects")).alias("recall"),
    )


def tracked_buckets(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Objects by the share of their frames in which they are tracked."""
    keys = keys or []
    per = events.where("oid is not null").groupBy(*keys, "oid").agg((F.count_if(F.col("type") != "MISS") / F.count("*")).alias("r"))
    return per.groupBy(*keys).agg(
        F.count_if(F.col("r") >= 0.8).alias("mostly_tracked"), F.count_if((F.col("r") >= 0.2) & (F.col("r") < 0.8)).alias("partially_tracked"),
        F.count_if(F.col("r") < 0.2).alias("mostly_lost"), F.count("*").alias("objects"),
    )


def weighted_average(value: Column, weight: Column) -> Column:
    """sum(x * w) / max(1, sum w)."""
    return F.sum(value * weight) / F.greatest(F.lit(1.0), F.sum(weight).cast("double"))


def path_consistency(gt_at: DataFrame, matches: DataFrame) -> DataFrame:
    """Of each sequence the path lengths of objects under their one best tracker id over all path lengths.

    gt_at has seq, t, id, x, y; matches seq, t, gt_id, tracker_id. A step counts for a tracker id when it
    matches the object at both of its ends; one id is assigned to one object, for most length in all.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("seq", "id").orderBy("t")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    steps = gt_at.withColumn("d", F.coalesce(step, F.lit(0.0))).withColumn("before", F.lag("t").over(w))
    total = steps.groupBy("seq").agg(F.sum("d").alias("total"))
    m = matches.select("seq", F.col("t").alias("mt"), F.col("gt_id").alias("id"), "tracker_id")
    now = steps.join(m, ["seq", "id"]).where("t = mt").drop("mt")
    both = now.join(m.withColumnRenamed("mt", "pt"), ["seq", "id", "tracker_id"]).where("before = pt")
    per = both.groupBy("seq", F.col("id").alias("gt_id"), "tracker_id").agg(F.sum("d").alias("length"))
    kind = dict(gt_at.dtypes)["seq"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        best = assign_sparse(pdf["gt_id"], pdf["tracker_id"], pdf["length"].to_numpy())
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]], "kept": [float(pdf["length"].to_numpy()[best].sum())]})

    kept = per.select("seq", "gt_id", "tracker_id", "length").groupBy("seq").applyInPandas(fold, f"seq {kind}, kept double")
    return total.join(kept, "seq", "left").select("seq", F.coalesce(F.try_divide(F.coalesce("kept", F.lit(0.0)), "total"), F.lit(0.0)).alias("IDEucl"))


def fragmentation(matches: DataFrame, gt: DataFrame) -> DataFrame:
    """Of each sequence the share of neighbouring matched frames of an object that keep their tracker id."""
    from pyspark.sql import Window

    w = Window.partitionBy("seq", "gt_id").orderBy("t")
    rows = gt.join(matches.select("seq", "t", "gt_id", "tracker_id"), ["seq", "t", "gt_id"], "left")
    same = F.coalesce(F.col("tracker_id") == F.lag("tracker_id").over(w), F.lit(False))
    pairs = rows.withColumn("same", same).withColumn("has", F.lag("t").over(w).isNotNull())
    return pairs.groupBy("seq").agg(F.coalesce(F.try_divide(F.count_if(F.col("same") & F.col("has")).cast("double"), F.count_if("has")), F.lit(1.0)).alias("FragA"))


def keypoint_hota(sim: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """HOTA for each joint (a column ``joint`` on all tables) and, as joint 'total', over all of them."""
    flat = lambda df: df.withColumn("seq", F.concat_ws("|", "joint", "seq")).drop("joint")
    per = hota(flat(sim), flat(gt), flat(pred)).withColumn("joint", F.split("seq", r"\|")[0])
    each = combined_hota(per, ["joint"])
    return each.unionByName(combined_hota(per).withColumn("joint", F.lit("total")))


def global_hota(sim: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Ids that hold across sequences: frames are told apart by sequence, association is over all."""
    frames = gt.select("seq", "t").unionByName(pred.select("seq", "t")).distinct()
    last = frames.groupBy("seq").agg((F.max("t") + 1).alias("n"))
    shift = ordered.running(last, "seq", [], {"upto": F.col("n")}).select("seq", (F.col("upto") - F.col("n")).alias("shift"))
    flat = lambda df: df.join(shift, "seq").withColumn("t", F.col("t") + F.col("shift")).drop("shift").withColumn("seq", F.lit("all"))
    return hota(flat(sim), flat(gt), flat(pred))
