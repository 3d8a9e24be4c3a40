"""Average precision of whole tracks, for several ranges of area and duration in one plan.

A predicted track and a true one overlap by their summed intersections over summed unions
(``tracking.track_overlap``). In falling score each prediction takes the free truth that it overlaps
most, at or above a threshold. In a range of areas or durations the truths outside it are ignored,
crowds always: such a truth may absorb a prediction only if no counted one can be taken, and what it
absorbs counts for nothing. Predictions that took nothing and lie outside the range, or come from a
sequence that is not labelled exhaustively, do not count either.

``box_track_precision`` takes tables of boxes: a sequence's frames follow each other in one task, which
adds up tracks and pairs of tracks that touch and matches them when the sequence ends, so boxes are
shuffled once. From ready overlaps, only pairs at or above the least threshold are matched. Scores are
ranked over all sequences by running sums in ranges of the score, without a task for a whole table.
Equal scores are ordered by sequence and id; of equal overlaps the larger truth id is taken. Recall
is compared as whole numbers. A range without counted truths has null results. Null scores come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes
from ..operators import frames as in_frames
from ..operators import ordered
from ..session import stored

_EPS = float(np.finfo(float).eps)
#: (name, column, least, most): fixed values of the usual ranges, in pixels and frames.
RANGES = [
    ("all", None, 0.0, 0.0),
    ("area_s", "area", 0.0, 1024.0),
    ("area_m", "area", 1024.0, 9216.0),
    ("area_l", "area", 9216.0, 1e10),
    ("time_s", "frames", 0.0, 3.0),
    ("time_m", "frames", 3.0, 10.0),
    ("time_l", "frames", 10.0, 1e5),
]
THRESHOLDS = [round(0.5 + 0.05 * k, 2) for k in range(10)]
#: Pairs of boxes that are compared at once.
PAIRS = 1 << 20
#: Recall is read at 0, 1/100, ..., 1.
RECALLS = 100


def measured(rows: DataFrame, keys: list[str], box: str = "box") -> DataFrame:
    """keys, area (mean of the boxes) and frames of each track."""
    return rows.groupBy(*keys).agg(F.avg(boxes.area(F.col(box))).alias("area"), F.count("*").alias("frames"))


def _within(column: str, least: float, most: float):
    return F.col(column).between(least - _EPS, most + _EPS)


def _inside(ranges: list) -> F.Column:
    """For each range whether a track lies in it."""
    return F.array(*(F.coalesce(_within(c, a, b), F.lit(False)) if c else F.lit(True) for _, c, a, b in ranges))


def _slices(rows: np.ndarray, owner: np.ndarray, most: int = 20_000) -> list[np.ndarray]:
    """Rows in slices of about ``most``, cut where their owner changes."""
    if len(rows) <= most:
        return [rows]
    starts = np.flatnonzero(np.diff(owner[rows], prepend=-1))
    return np.split(rows, starts[np.flatnonzero(np.diff(starts // most)) + 1])


def _greedy(group: np.ndarray, gt_id: np.ndarray, tracker: np.ndarray, iou: np.ndarray, score: np.ndarray, counted: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order, new, mine, got, range, level, ignored) of many sequences' pairs: their order, where a prediction begins in it, the number of each pair's prediction,
    and the pairs, by their place in the order, that are taken. Null scores are last."""
    order = np.lexsort([gt_id, iou, tracker, -score, group])
    group, gt, who, iou, counted = group[order], gt_id[order], tracker[order], iou[order], counted[order]
    new = np.ones(len(who), bool)
    new[1:] = (np.diff(group) != 0) | (np.diff(who) != 0)
    mine = np.cumsum(new) - 1
    truth = pd.MultiIndex.from_arrays([group, gt]).factorize()[0]
    # a prediction comes one level after the last one before it that overlaps a truth of its own; those of a level do not disturb each other
    level, last, begins = np.zeros(mine[-1] + 1, np.int64), [0] * (int(truth.max()) + 1), [*np.flatnonzero(new).tolist(), len(who)]
    named = truth.tolist()
    for k in range(len(level)):
        own = named[begins[k] : begins[k + 1]]
        level[k] = at = max(last[g] for g in own) + 1
        for g in own:
            last[g] = at
    free = np.ones((len(last), counted.shape[1], len(levels)), bool)
    out = []
    by_level = np.argsort(level[mine], kind="stable")
    cuts = np.flatnonzero(np.diff(level[mine][by_level])) + 1
    for rows in (part for same in np.split(by_level, cuts) for part in _slices(same, mine)):
        # the last that fits is taken, a counted one before any ignored one
        worth = np.arange(1, len(rows) + 1)[:, None, None] + len(rows) * counted[rows][:, :, None]
        worth = np.where(free[truth[rows]] & (iou[rows][:, None] >= levels)[:, None, :], worth, 0)
        starts = np.flatnonzero(np.diff(mine[rows], prepend=-1))
        best = np.maximum.reduceat(worth, starts)
        p, r, t = np.nonzero(best)
        got = rows[(best[p, r, t] - 1) % len(rows)]
        free[truth[got], r, t] = False
        out.append((got, r, t, best[p, r, t] <= len(rows)))
    return order, new, mine, *(np.concatenate(c) for c in zip(*out, strict=True))


def track_matches(
    overlaps: DataFrame, truth: DataFrame, predicted: DataFrame, ranges: list | None = None, thresholds: list[float] | None = None, wide: bool = False
) -> DataFrame:
    """seq, tracker_id, range, threshold, gt_id, ignored for every prediction that took a truth.

    overlaps(seq, gt_id, tracker_id, iou); truth(seq, gt_id, area, frames, and crowd where there are any);
    predicted(seq, tracker_id, score, ...). With ``wide`` seq, tracker_id and took, for each range and, within it, threshold
    0 where nothing was taken, 1 where a counted truth and 2 where an ignored one was.
    """
    ranges, thresholds = ranges or RANGES, thresholds or THRESHOLDS
    kind = dict(overlaps.dtypes)["seq"]
    crowd = F.coalesce(F.col("crowd"), F.lit(False)) if "crowd" in truth.columns else F.lit(False)
    counted = F.transform(_inside(ranges), lambda x: x & ~crowd)
    pairs = overlaps.where(F.col("iou") >= min(thresholds) - _EPS).join(truth.select("seq", "gt_id", counted.alias("counted")), ["seq", "gt_id"])
    pairs = pairs.join(predicted.select("seq", "tracker_id", "score"), ["seq", "tracker_id"]).select("seq", "gt_id", "tracker_id", "iou", "score", "counted")
    levels = _levels(thresholds)

    def take(pdf: pd.DataFrame, firsts: np.ndarray) -> pd.DataFrame:
        group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(pdf))))
        gt_id, tracker = pdf["gt_id"].to_numpy(np.int64), pdf["tracker_id"].to_numpy(np.int64)
        counted_ = np.array(pdf["counted"].tolist(), bool).reshape(len(pdf), len(ranges))
        order, new, mine, got, r, t, ignored = _greedy(group, gt_id, tracker, pdf["iou"].to_numpy(float), pdf["score"].to_numpy(float), counted_, levels)
        who, seq = tracker[order], pdf["seq"].to_numpy()[order]
        if wide:
            took = np.zeros((int(new.sum()), len(ranges) * len(levels)), np.int8)
            took[mine[got], r * len(levels) + t] = 1 + ignored
            return pd.DataFrame({"seq": seq[new], "tracker_id": who[new], "took": list(took)})
        return pd.DataFrame({"seq": seq[got], "tracker_id": who[got], "range": r, "threshold": t, "gt_id": gt_id[order][got], "ignored": ignored})

    if wide:
        return in_frames.by_group(pairs, ["seq"], take, f"seq {kind}, tracker_id long, took array<tinyint>")
    return in_frames.by_group(pairs, ["seq"], take, f"seq {kind}, tracker_id long, range int, threshold int, gt_id long, ignored boolean")


def _levels(thresholds: list[float]) -> np.ndarray:
    return np.minimum(np.array(thresholds), 1 - 1e-10) - _EPS


def _touching(frame: np.ndarray, real: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, pixels): truths and predictions of a frame that share a part, by a search among the left edges of the frame's predictions."""
    sound = ~np.isnan(box).any(axis=1)
    g, p = np.flatnonzero(real & sound), np.flatnonzero(~real & sound)
    if not len(g) or not len(p):
        return g[:0], p[:0], np.zeros(0)
    edges, place = np.unique(box[p, 0], return_inverse=True)
    key = frame[p] * (len(edges) + 1) + place
    p, key = p[np.argsort(key)], np.sort(key)
    widest = np.zeros(int(frame.max()) + 1)
    np.maximum.at(widest, frame[p], box[p, 2] - box[p, 0])
    low = box[g, 0] - widest[frame[g]]
    low -= 1e-9 * (np.abs(low) + np.abs(box[g, 0]))  # a width is rounded
    base = frame[g] * (len(edges) + 1)
    begin, end = (np.searchsorted(key, base + np.searchsorted(edges, x)) for x in (low, box[g, 2]))
    per, out = np.maximum(end - begin, 0), []
    for k in np.split(np.arange(len(g)), np.flatnonzero(np.diff(np.cumsum(per) // PAIRS)) + 1):
        a = np.repeat(g[k], per[k])
        b = p[np.repeat(begin[k], per[k]) + np.arange(len(a)) - np.repeat(np.cumsum(per[k]) - per[k], per[k])]
        wide, high = (np.minimum(box[a, c + 2], box[b, c + 2]) - np.maximum(box[a, c], box[b, c]) for c in (0, 1))
        some = (wide > 0) & (high > 0)
        out.append((a[some], b[some], (wide * high)[some]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def box_marks(truth: DataFrame, predicted: DataFrame, ranges: list, thresholds: list[float]) -> DataFrame:
    """seq, tracker_id, score, marks of every predicted track, as ``best_precisions`` takes them, and rows without them that hold counted truths by range, to be added.

    truth: seq, id, t, box and, where there are any, crowd; predicted: seq, id, t, box, score and perhaps open, the same in all rows of a track.
    All frames of a sequence are in one task: sums for tracks and for pairs of tracks that touch are made there, and matched there when the sequence ends.
    """
    kind = dict(truth.dtypes)["seq"]
    names = ["left", "top", "right", "bottom"]

    def side(df: DataFrame, real: bool, score, flag: str) -> DataFrame:
        flag = F.coalesce(F.col(flag), F.lit(False)) if flag in df.columns else F.lit(False)
        edges = (F.col("box")[k].cast("double").alias(n) for k, n in enumerate(names))
        return df.select("seq", "t", F.lit(real).alias("real"), F.col("id").cast("long").alias("id"), *edges, score.cast("double").alias("score"), flag.alias("flag"))

    rows = side(truth, True, F.lit(None), "crowd").unionByName(side(predicted, False, F.col("score"), "open"))
    levels, steps = _levels(thresholds), len(thresholds)

    def meet(many: pd.DataFrame, firsts: np.ndarray) -> pd.DataFrame:
        frame = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(many))))
        seq, ids, real = pd.factorize(many["seq"], use_na_sentinel=False)[0], many["id"].to_numpy(np.int64), many["real"].to_numpy(bool)
        box = many[names].to_numpy(float)
        area = np.maximum(box[:, 2] - box[:, 0], 0) * np.maximum(box[:, 3] - box[:, 1], 0)
        each = {"at": np.arange(len(many)), "s": seq, "real": real, "id": ids, "sum": np.nan_to_num(area), "known": ~np.isnan(area), "frames": 1, "score": many["score"], "flag": many["flag"]}
        own = pd.DataFrame(each).groupby(["s", "real", "id"], sort=False).agg({"at": "first", "sum": "sum", "known": "sum", "frames": "sum", "score": "first", "flag": "first"}).reset_index()
        own["gt_id"], own["tracker_id"] = own["id"].astype("Int64").where(own["real"]), own["id"].astype("Int64").mask(own["real"])
        a, b, part = _touching(frame, real, box)
        both = pd.DataFrame({"at": a, "s": seq[a], "gt_id": ids[a], "tracker_id": ids[b], "sum": part}).groupby(["s", "gt_id", "tracker_id"], sort=False).agg({"at": "first", "sum": "sum"}).reset_index()
        both = both.astype({"gt_id": "Int64", "tracker_id": "Int64"}).assign(known=0, frames=0, score=np.nan, flag=False)
        found = pd.concat([own, both], ignore_index=True).sort_values("s", kind="stable")  # sequences as they came
        found["seq"] = many["seq"].to_numpy()[found["at"]]
        return found[["seq", "gt_id", "tracker_id", "sum", "known", "frames", "score", "flag"]]

    def judge(many: pd.DataFrame, firsts: np.ndarray) -> pd.DataFrame:
        many = many.assign(g=np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(many)))))
        whole = {"sum": "sum", "known": "sum", "frames": "sum", "score": "first", "flag": "first"}
        no_gt, no_tr = many["gt_id"].isna(), many["tracker_id"].isna()
        t = many[no_tr].astype({"gt_id": np.int64}).groupby(["g", "gt_id"]).agg(whole)
        p = many[no_gt].astype({"tracker_id": np.int64}).groupby(["g", "tracker_id"]).agg(whole)
        inside = []
        for x in (t, p):
            mean = (x["sum"] / x["known"].where(x["known"] > 0)).to_numpy(float)
            by = {None: np.zeros(len(x)), "area": mean, "frames": x["frames"].to_numpy(float)}
            fits = [(by[c] >= (a - _EPS if c else 0)) & (by[c] <= (b + _EPS if c else 0)) for _, c, a, b in ranges]
            inside.append(np.stack(fits, axis=1) & ~x["flag"].to_numpy(bool)[:, None])
        counted, counts = inside
        marks = np.where(np.repeat(counts, steps, axis=1), 2, 0).astype(np.int8)
        pairs = many[~no_gt & ~no_tr].astype({"gt_id": np.int64, "tracker_id": np.int64}).groupby(["g", "gt_id", "tracker_id"])["sum"].sum().reset_index()
        at_t, at_p = t.index.get_indexer(pd.MultiIndex.from_frame(pairs[["g", "gt_id"]])), p.index.get_indexer(pd.MultiIndex.from_frame(pairs[["g", "tracker_id"]]))
        common = pairs["sum"].to_numpy(float)
        union = t["sum"].to_numpy(float)[at_t] + p["sum"].to_numpy(float)[at_p] - common
        iou = np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)
        near = iou >= min(thresholds) - _EPS
        if near.any():
            pairs, at_t, at_p = pairs[near], at_t[near], at_p[near]
            score = p["score"].to_numpy(float)[at_p]
            order, new, mine, got, r, level, ignored = _greedy(*(pairs[c].to_numpy(np.int64) for c in ("g", "gt_id", "tracker_id")), iou[near], score, counted[at_t], levels)
            marks[at_p[order][got], r * steps + level] = np.where(ignored, 0, 1)
        seq = many["seq"].to_numpy()[firsts]
        out = pd.DataFrame({"seq": seq[p.index.get_level_values(0)], "tracker_id": p.index.get_level_values(1).astype("Int64"), "score": p["score"].to_numpy(float), "marks": list(marks), "n_truth": None})
        if len(t):
            out = pd.concat([out, pd.DataFrame({"seq": seq[:1], "tracker_id": pd.array([pd.NA], "Int64"), "score": [np.nan], "marks": [None], "n_truth": [counted.sum(axis=0).tolist()]})], ignore_index=True)
        return out

    return in_frames.by_group(rows, ["seq", "t"], meet, f"seq {kind}, tracker_id long, score double, marks array<tinyint>, n_truth array<bigint>", ["seq"], judge)


def _best_precisions(batches: Iterator[pd.DataFrame], eps: float = _EPS) -> Iterator[pd.DataFrame]:
    """The best precision of each cell at each place of recall, over rows of marks in order of falling score; a row with ``base`` begins a range."""
    best, sums, n = None, None, None
    for batch in batches:
        begins = np.flatnonzero(batch["base"].notna().to_numpy())
        for a, b in zip([0, *begins], [*begins, len(batch)], strict=True):
            if a < b and batch["base"].iloc[a] is not None:
                base = np.array(batch["base"].iloc[a], np.int64).reshape(-1, 3)
                sums, n, a = base[:, :2].T, base[:, 2], a + 1
                best = np.full((len(n), RECALLS + 1), -1.0) if best is None else best
            if a >= b or sums is None:  # without truth there is no range
                continue
            marks = np.array(batch["marks"].iloc[a:b].tolist(), np.int8)
            tp, fp = sums[0] + np.cumsum(marks == 1, axis=0), sums[1] + np.cumsum(marks == 2, axis=0)
            sums = np.stack([tp[-1], fp[-1]])
            row, cell = np.nonzero((marks > 0) & (n > 0))
            tp, fp = tp[row, cell], fp[row, cell]
            np.maximum.at(best, (cell, np.minimum(tp * RECALLS // n[cell], RECALLS)), tp / (tp + fp + eps))
    if best is not None:
        cell, k = np.nonzero(best >= 0)
        yield pd.DataFrame({"cell": cell, "k": k, "p": best[cell, k]})


def best_precisions(rows: DataFrame, score: str, tie: list[str], truths: DataFrame, spread: str | None = None, eps: float = _EPS) -> tuple[DataFrame, DataFrame]:
    """(cell, k, p), the best precision of each cell at recalls of k hundredths or more, and (cell, tp, fp), its counts.

    rows: score, the columns of ``tie``, marks (array<tinyint>: for each cell 1 for a hit, 2 for a false one, 0 for neither);
    truths: cell, n_truth. All cells are counted along one order, by falling score, then ``tie``; it is cut into ranges of the
    score, of one score by ``spread``, and what is counted before a range comes as its first row. rows are read three times.
    """
    placed = ordered.ranged(rows, score, "__k", falling=True, spread=spread)
    cells = placed.select("__k", F.posexplode("marks").alias("cell", "mark")).groupBy("__k", "cell").agg(F.count_if(F.col("mark") == 1).alias("tp"), F.count_if(F.col("mark") == 2).alias("fp"))
    before = Window.partitionBy("cell").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sums = (F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("tp", "fp"))
    bases = cells.select("__k", "cell", *sums).join(F.broadcast(truths), "cell")
    one = F.sort_array(F.collect_list(F.struct("cell", "tp", "fp", "n_truth")))
    bases = bases.groupBy("__k").agg(F.flatten(F.transform(one, lambda s: F.array(s["tp"], s["fp"], s["n_truth"]))).alias("base"))
    kinds = dict(rows.dtypes)
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    columns = list(dict.fromkeys([score, *tie, "marks"]))
    led = placed.select("__k", *columns, F.lit(None).cast("array<bigint>").alias("base")).unionByName(bases.select("__k", "base", *map(null, columns)))
    led = led.repartition("__k").sortWithinPartitions("__k", F.col("base").isNull(), F.desc_nulls_last(score), *tie).select("base", "marks")
    best = led.mapInPandas(lambda batches: _best_precisions(batches, eps), "cell int, k int, p double").groupBy("cell", "k").agg(F.max("p").alias("p"))
    upto = best.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("k")))).groupBy("cell", "k").agg(F.max("p").alias("p"))
    return upto, cells.groupBy("cell").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))


def track_precision(overlaps: DataFrame, truth: DataFrame, predicted: DataFrame, ranges: list | None = None, thresholds: list[float] | None = None) -> DataFrame:
    """range, threshold, ap, ar, n_truth, n_predicted; predictions may have ``open``, true where a sequence is not labelled exhaustively."""
    ranges, thresholds = ranges or RANGES, thresholds or THRESHOLDS
    taken = track_matches(overlaps, truth, predicted, ranges, thresholds, wide=True)
    crowd = F.coalesce(F.col("crowd"), F.lit(False)) if "crowd" in truth.columns else F.lit(False)
    n_truth = truth.select(F.posexplode(F.transform(_inside(ranges), lambda x: (x & ~crowd).cast("int"))).alias("range", "n")).groupBy("range").agg(F.sum("n").alias("n_truth"))
    counts = F.transform(_inside(ranges), lambda x: x & ~(F.coalesce(F.col("open"), F.lit(False)) if "open" in predicted.columns else F.lit(False)))
    steps = len(thresholds)
    none = F.array_repeat(F.lit(0).cast("tinyint"), len(ranges) * steps)
    mark = lambda took, i: F.when(took == 1, 1).when((took == 0) & F.get("counts", (i / steps).cast("int")), 2).otherwise(0).cast("tinyint")
    full = predicted.select("seq", "tracker_id", "score", counts.alias("counts")).join(taken, ["seq", "tracker_id"], "left")
    rows = stored(full.select("seq", "tracker_id", "score", F.transform(F.coalesce("took", none), mark).alias("marks")))
    return _precisions(rows, n_truth, ranges, thresholds)


def box_track_precision(truth: DataFrame, predicted: DataFrame, ranges: list | None = None, thresholds: list[float] | None = None) -> DataFrame:
    """``track_precision`` of tracks of boxes, measured, overlapped and matched in one pass; see ``box_marks``."""
    ranges, thresholds = ranges or RANGES, thresholds or THRESHOLDS
    rows = stored(box_marks(truth, predicted, ranges, thresholds))
    n_truth = rows.where("n_truth is not null").select(F.posexplode("n_truth").alias("range", "n")).groupBy("range").agg(F.sum("n").alias("n_truth"))
    return _precisions(rows.where("marks is not null").drop("n_truth"), n_truth, ranges, thresholds)


def _precisions(rows: DataFrame, n_truth: DataFrame, ranges: list, thresholds: list[float]) -> DataFrame:
    """The results of ``track_precision`` from marks (range by range, its thresholds in order) and range, n_truth."""
    steps = len(thresholds)
    of_cell = [(F.col("cell") / steps).cast("int").alias("range"), (F.col("cell") % steps).alias("threshold")]
    truths = n_truth.select(F.explode(F.sequence(F.col("range") * steps, F.col("range") * steps + steps - 1)).alias("cell"), "n_truth")
    best, counted = best_precisions(rows, "score", ["seq", "tracker_id"], truths)
    ap = best.groupBy(*of_cell).agg((F.sum("p") / (RECALLS + 1)).alias("ap"))
    whole = counted.select(*of_cell, F.col("tp").alias("hits"), (F.col("tp") + F.col("fp")).alias("n_predicted"))
    grid = n_truth.withColumn("threshold", F.explode(F.sequence(F.lit(0), F.lit(len(thresholds) - 1))))
    full = grid.join(F.broadcast(ap), ["range", "threshold"], "left").join(F.broadcast(whole), ["range", "threshold"], "left")
    some = F.col("n_truth") > 0
    return full.select(
        F.get(F.array(*(F.lit(r[0]) for r in ranges)), F.col("range")).alias("range"), F.get(F.array(*map(F.lit, thresholds)), F.col("threshold")).alias("threshold"),
        F.when(some, F.coalesce("ap", F.lit(0.0))).alias("ap"), F.when(some, F.coalesce(F.col("hits") / F.col("n_truth"), F.lit(0.0))).alias("ar"),
        "n_truth", F.coalesce("n_predicted", F.lit(0)).cast("long").alias("n_predicted"),
    )


def averaged(per: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean over thresholds and, where ``per`` holds several classes, over them: null results of empty ranges do not count."""
    return per.groupBy(*(keys or []), "range").agg(F.avg("ap").alias("ap"), F.avg("ar").alias("ar"))
