"""Whole tracks, clean-up of segments and their matching, each against a plain version on dense data."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.evaluation import track_precision as precision
from touchline.evaluation import regions, tracking
from touchline.functions import masks
from touchline.operators import cleanup, segments

RANGES = [("all", None, 0.0, 0.0), ("small", "area", 0.0, 50.0), ("long", "frames", 4.0, 100.0)]
LEVELS = [0.5, 0.7]


def plain_matches(truth, predicted, iou, lo_hi, level):
    """Predictions in falling score over all truths, counted ones first; the larger id of equal overlaps."""
    taken, out = set(), {}
    inside = lambda row: lo_hi[1] is None or lo_hi[2] <= row[{"area": 1, "frames": 2}[lo_hi[1]]] <= lo_hi[3]
    for p in sorted(predicted, key=lambda p: (-p[3], p[0])):
        for counted in (True, False):
            fits = [(iou[g[0], p[0]], g[0]) for g in truth if (inside(g) and not g[3]) == counted and g[0] not in taken and iou.get((g[0], p[0]), 0) >= level]
            if fits:
                taken.add(max(fits)[1])
                out[p[0]] = (max(fits)[1], not counted)
                break
    return out


def plain_precision(seqs, lo_hi, level):
    inside = lambda row: lo_hi[1] is None or lo_hi[2] <= row[{"area": 1, "frames": 2}[lo_hi[1]]] <= lo_hi[3]
    rows, total = [], 0
    for s, (truth, predicted, iou) in seqs.items():
        got = plain_matches(truth, predicted, iou, lo_hi, level)
        total += sum(inside(g) and not g[3] for g in truth)
        for p in predicted:
            if p[0] in got and not got[p[0]][1]:
                rows.append((-p[3], s, p[0], 1))
            elif p[0] not in got and inside(p) and not p[4]:
                rows.append((-p[3], s, p[0], 0))
    if not total:
        return None, None
    tp = np.cumsum([r[3] for r in sorted(rows)])
    recall, right = tp / total, tp / np.arange(1, len(tp) + 1)
    return np.mean([max([q for r, q in zip(recall, right, strict=True) if r >= k / 100 - 1e-12], default=0) for k in range(101)]), (tp[-1] / total if len(tp) else 0)


def test_track_precision_matches_a_plain_version(spark):
    rng = random.Random(4)
    seqs = {}
    for s in range(12):
        truth = [(g, rng.uniform(10, 100), rng.randint(1, 8), rng.random() < 0.2) for g in range(rng.randint(0, 6))]
        predicted = [(p, rng.uniform(10, 100), rng.randint(1, 8), rng.choice([0.2, 0.5, 0.5, 0.9]), s == 3) for p in range(rng.randint(0, 8))]
        iou = {(g[0], p[0]): rng.choice([0.4, 0.55, 0.6, 0.7, 0.8, 0.9]) for g in truth for p in predicted if rng.random() < 0.5}
        seqs[s] = (truth, predicted, iou)
    o = spark.createDataFrame([(s, *k, v) for s, x in seqs.items() for k, v in x[2].items()], "seq long, gt_id long, tracker_id long, iou double")
    t = spark.createDataFrame([(s, *g) for s, x in seqs.items() for g in x[0]], "seq long, gt_id long, area double, frames long, crowd boolean")
    p = spark.createDataFrame([(s, *q) for s, x in seqs.items() for q in x[1]], "seq long, tracker_id long, area double, frames long, score double, open boolean")
    got = {(r["seq"], r["range"], r["threshold"], r["tracker_id"]): (r["gt_id"], r["ignored"]) for r in precision.track_matches(o, t, p, RANGES, LEVELS).collect()}
    want = {(s, i, j, q): m for s, x in seqs.items() for i, r in enumerate(RANGES) for j, level in enumerate(LEVELS) for q, m in plain_matches(*x, r, level).items()}
    assert got == want
    full = {(r["range"], r["threshold"]): (r["ap"], r["ar"]) for r in precision.track_precision(o, t, p, RANGES, LEVELS).collect()}
    for r in RANGES:
        for level in LEVELS:
            assert full[r[0], level] == pytest.approx(plain_precision(seqs, r, level)), (r, level)
    mean = {r["range"]: r["ap"] for r in precision.averaged(precision.track_precision(o, t, p, RANGES, LEVELS)).collect()}
    assert mean["all"] == pytest.approx(np.mean([plain_precision(seqs, RANGES[0], level)[0] for level in LEVELS]))


def test_track_precision_of_nothing(spark):
    o = spark.createDataFrame([], "seq long, gt_id long, tracker_id long, iou double")
    t = spark.createDataFrame([(1, 1, 5.0, 2)], "seq long, gt_id long, area double, frames long")
    p = spark.createDataFrame([], "seq long, tracker_id long, area double, frames long, score double")
    got = precision.track_precision(o, t, p, RANGES, [0.5]).collect()
    assert {(r["range"], r["ap"], r["ar"], r["n_truth"]) for r in got} == {("all", 0.0, 0.0, 1), ("small", 0.0, 0.0, 1), ("long", None, None, 0)}


# Masks


def blob(rng, h, w):
    m = np.zeros((h, w), bool)
    for _ in range(rng.randint(0, 4)):
        y, x = rng.randrange(h), rng.randrange(w)
        m[y : y + rng.randint(1, h // 2), x : x + rng.randint(1, w // 2)] = True
    return m


def dense_pieces(m):
    left, sizes = m.copy(), []
    while left.any():
        todo = [tuple(np.argwhere(left)[0])]
        left[todo[0]] = False
        n = 0
        while todo:
            y, x = todo.pop()
            n += 1
            for v in range(max(y - 1, 0), min(y + 2, m.shape[0])):
                for u in range(max(x - 1, 0), min(x + 2, m.shape[1])):
                    if left[v, u]:
                        left[v, u] = False
                        todo.append((v, u))
        sizes.append(n)
    return sorted(sizes, reverse=True)


def test_runs_say_what_pixels_say(spark):
    rng = random.Random(9)
    pairs = [(blob(rng, 12, 17), blob(rng, 12, 17)) for _ in range(60)] + [(np.ones((12, 17), bool), np.zeros((12, 17), bool))]
    df = spark.createDataFrame([(k, masks.encode(a), masks.encode(b), 12, 17) for k, (a, b) in enumerate(pairs)], "k int, a string, b string, h int, w int")
    got = df.select("k", masks.mask_iou("a", "b", "h", "w").alias("iou"), masks.box_of_mask("a", "h", "w").alias("box"), masks.piece_sizes("a", "h", "w").alias("pieces")).orderBy("k").collect()
    for r, (a, b) in zip(got, pairs, strict=True):
        union = (a | b).sum()
        assert r["iou"] == pytest.approx((a & b).sum() / union if union else 0.0)
        rows, columns = np.flatnonzero(a.any(1)), np.flatnonzero(a.any(0))
        assert r["box"] == ([columns[0], rows[0], columns[-1], rows[-1]] if len(rows) else None)
        assert r["pieces"] == dense_pieces(a)


def test_cleaned_masks():
    m = np.zeros((40, 40), bool)
    m[10:30, 10:30] = True
    m[20, 20] = False  # a hole is closed
    m[35, 35] = m[2:4, 2:4] = True  # specks go
    out = masks.cleaned(m, 5)
    assert out[20, 20] and not out[35, 35] and not out[2:4, 2:4].any() and out[12:28, 12:28].all()
    assert not masks.cleaned(np.zeros((5, 5), bool)).any() and masks.cleaned(np.ones((9, 9), bool)).all()


# Clean-up outward


def plain_walk(frames, prompt, limits, shape):
    """The same by two loops over a dict of all frames."""
    state = {f: dict(r, constrained=False, outlier=False, reached=False) for f, r in frames.items()}

    def usable(f):
        return f in state and state[f]["valid"]

    def one(f, before):
        r = state[f]
        cut = cleanup.clipped(r["box"], before, limits) if r["pieces"] != 1 and r["box"] is not None else None
        mask = masks.decode(r["mask"], *shape) if r["mask"] else None
        if cut:
            r["constrained"] = True
            r["box"] = tuple(float(int(v)) for v in cut)
            if mask is not None:
                keep = np.zeros_like(mask)
                keep[int(cut[1]) : int(cut[3]), int(cut[0]) : int(cut[2])] = True
                mask &= keep
                ys, xs = np.nonzero(mask)
                if len(ys):
                    r["box"] = (float(xs.min()), float(ys.min()), float(xs.max()), float(ys.max()))
        below = []
        for k in (f - 2, f - 1):
            if not usable(k) or state[k]["box"] is None:
                break
            below.append(state[k]["box"])
        r["outlier"] = cleanup.outlying(r["box"], below, limits)
        if mask is not None and (cut or r["outlier"]):
            ys, xs = np.nonzero(masks.cleaned(mask, limits.kernel))
            if not len(ys):
                r["valid"], r["box"] = False, None
                return False
            r["box"] = (float(xs.min()), float(ys.min()), float(xs.max()), float(ys.max()))
        return True

    if not usable(prompt):
        return state
    lo = hi = prompt
    while usable(lo - 1):
        lo -= 1
    while usable(hi + 1):
        hi += 1
    for f in range(lo, hi + 1):
        state[f]["reached"] = True
    for way, end in ((-1, lo), (1, hi)):
        f, before, fine = prompt, None, True
        while True:
            if fine and state[f]["valid"]:
                fine = one(f, before)
            elif not fine:
                state[f]["valid"], state[f]["box"] = False, None
            before = state[f]["box"] if state[f]["valid"] else None
            if f == end:
                break
            f += way
    return state


@pytest.mark.parametrize("with_masks", [False, True])
def test_clean_up_matches_two_plain_loops(spark, with_masks):
    rng = random.Random(21 + with_masks)
    limits = cleanup.Limits(small=20, usual=24, large=90, wider=6, higher=6)
    shape = (60, 80)
    tracks, rows = {}, []
    for k in range(30):
        x, y, w, h = rng.uniform(5, 40), rng.uniform(5, 30), rng.uniform(8, 20), rng.uniform(8, 20)
        frames = {}
        for f in range(rng.randint(1, 25)):
            if rng.random() < 0.05:
                continue
            x, y = min(max(x + rng.uniform(-2, 2), 0), 50), min(max(y + rng.uniform(-2, 2), 0), 30)
            grown = rng.choice([1, 1, 1, 1, 1.3, 2, 3])
            box = tuple(float(int(v)) for v in (x, y, min(x + w * grown, 79), min(y + h * grown, 59)))
            mask = None
            if with_masks:
                m = np.zeros(shape, bool)
                m[int(box[1]) : int(box[3]) + 1, int(box[0]) : int(box[2]) + 1] = True
                if rng.random() < 0.15:  # thin: nothing is left once it is opened
                    m[:] = False
                    m[int(box[1]), int(box[0]) : int(box[2]) + 1] = m[int(box[3]), int(box[0]) : int(box[2]) + 1] = True
                mask = masks.encode(m)
            frames[f] = {"box": box, "valid": rng.random() > 0.04, "mask": mask, "pieces": rng.choice([1, 2, 3])}
        tracks[k] = (frames, rng.randint(0, 20))
        rows += [(f"v{k % 3}", k, f, tracks[k][1], list(r["box"]), r["valid"], r["mask"], r["pieces"]) for f, r in frames.items()]
    df = spark.createDataFrame(rows, "video string, obj long, frame long, prompt long, box array<double>, valid boolean, mask string, pieces long")
    got = {(r["obj"], r["frame"]): r for r in cleanup.clean_outward(df.repartition(5), ["video", "obj"], "frame", "prompt", limits, shape).collect()}
    assert len(got) == len(rows)
    constrained = outliers = failed = 0
    for k, (frames, prompt) in tracks.items():
        for f, r in plain_walk(frames, prompt, limits, shape).items():
            g = got[k, f]
            assert (tuple(g["box"]) if g["box"] else None, g["valid"], g["constrained"], g["outlier"], g["reached"]) == (r["box"], r["valid"], r["constrained"], r["outlier"], r["reached"]), (k, f, prompt)
            constrained, outliers, failed = constrained + r["constrained"], outliers + r["outlier"], failed + (r["reached"] and not r["valid"])
    assert constrained > 10 and outliers > 3 and (failed > 3) == with_masks


def test_a_long_track_is_walked_in_batches(spark):
    n = 200_000
    x = (F.col("id") % 50).cast("double")
    df = spark.range(n).select(F.lit("v").alias("obj"), F.col("id").alias("frame"), F.lit(n // 2).alias("prompt"), F.array(x, x, x + 100, x + 100).alias("box"), F.lit(True).alias("valid"))
    out = cleanup.clean_outward(df, ["obj"], "frame", "prompt")
    assert out.agg(F.count("*"), F.count_if("reached"), F.count_if("valid")).first()[:] == (n, n, n)


# Segments and detections


def plain_cascade(segs, dets, shape):
    taken, there, out = set(), [], {}
    for place, obj, box, mask in sorted(segs, key=lambda s: s[0]):
        m = masks.decode(mask, *shape) if mask else None
        scored = []
        for d, other in sorted(dets):
            if d in taken:
                continue
            w, h = min(box[2], other[2]) - max(box[0], other[0]), min(box[3], other[3]) - max(box[1], other[1])
            i = max(w, 0) * max(h, 0)
            sa, sb = (box[2] - box[0]) * (box[3] - box[1]), (other[2] - other[0]) * (other[3] - other[1])
            scored.append((d, i / (sa + sb - i) if sa + sb > i else 0, i / sa if sa else 0, i / sb if sb else 0))
        a = max(scored, key=lambda s: s[1], default=None)
        b = max(scored, key=lambda s: s[2], default=None)
        det = None
        if a and a[1] > 0.5:
            det = a[0]
        elif b and b[2] > 0.7:
            det = b[0]
        if det is not None:
            taken.add(det)
            there.append((obj, m, True))
            out[place] = (det, "matched")
            continue
        twice = sum(s[3] > 0.6 for s in scored) > 1
        for o, other, matched in there:
            if other is None:
                twice = twice or (matched and o == obj)
            elif m is not None:
                i, u = (m & other).sum(), (m | other).sum()
                twice = twice or (i > 0 and (o == obj or i / u > 0.6 or i / m.sum() > 0.6))
        if not twice:
            there.append((obj, m, False))
        out[place] = (None, "duplicate" if twice else "new")
    return out


def test_segments_take_detections(spark):
    rng = random.Random(3)
    shape = (40, 50)
    segs, dets = [], []
    for f in range(40):
        boxes = []
        for p in range(rng.randint(1, 7)):
            x, y = rng.randint(0, 30), rng.randint(0, 20)
            if boxes and rng.random() < 0.4:
                x, y = (int(v) + rng.randint(-1, 1) for v in rng.choice(boxes)[:2])
            x, y = max(x, 0), max(y, 0)
            box = [float(x), float(y), float(x + rng.randint(3, 15)), float(y + rng.randint(3, 15))]
            m = np.zeros(shape, bool)
            m[int(box[1]) : int(box[3]), int(box[0]) : int(box[2])] = True
            boxes.append(box)
            segs.append((f, p, rng.randint(1, 4), box, masks.encode(m) if rng.random() < 0.9 else None))
        for d in range(rng.randint(0, 5)):
            x, y, x2, y2 = rng.choice(boxes)
            dets.append((f, d, [x + rng.randint(0, 3), y, x2 + rng.randint(0, 3), y2]))
    s = spark.createDataFrame(segs, "frame long, place long, obj_id long, box array<double>, mask string")
    t = spark.createDataFrame(dets, "frame long, det long, box array<double>")
    got = {(r["frame"], r["place"]): (r["det"], r["outcome"]) for r in segments.match_segments(s, t, ["frame"]).collect()}
    want = {(f, p): v for f in range(40) for p, v in plain_cascade([x[1:] for x in segs if x[0] == f], [x[1:] for x in dets if x[0] == f], shape).items()}
    assert got == want
    assert {v[1] for v in want.values()} == {"matched", "duplicate", "new"}


def test_tracks_of_masks_overlap(spark):
    rng = random.Random(8)
    tracks = {(side, k): {t: blob(rng, 10, 10) for t in range(5) if rng.random() < 0.8} for side in "ab" for k in range(3)}
    rows = lambda side: spark.createDataFrame([(1, k, t, masks.encode(m)) for (s, k), x in tracks.items() if s == side for t, m in x.items()], "seq long, id long, t long, mask string")
    got = {(r["a_id"], r["b_id"]): r["iou"] for r in segments.mask_track_overlap(rows("a"), rows("b")).collect()}
    none = np.zeros((10, 10), bool)
    for i in range(3):
        for j in range(3):
            a, b = tracks["a", i], tracks["b", j]
            common = sum((a.get(t, none) & b.get(t, none)).sum() for t in range(5))
            union = sum((a.get(t, none) | b.get(t, none)).sum() for t in range(5))
            assert got.get((i, j), 0) == pytest.approx(common / union if union else 0)


def test_overlaps_reach_the_precision(spark):
    box = lambda x: [float(x), 0.0, float(x) + 10, 10.0]
    a = spark.createDataFrame([(1, 1, t, box(t)) for t in range(4)], "seq long, id long, t long, box array<double>")
    b = spark.createDataFrame([(1, 7, t, box(t + 1)) for t in range(4)], "seq long, id long, t long, box array<double>")
    o = tracking.track_overlap(a, b).withColumnsRenamed({"a_id": "gt_id", "b_id": "tracker_id"})
    t = precision.measured(a, ["seq", "id"]).withColumnRenamed("id", "gt_id")
    p = precision.measured(b, ["seq", "id"]).withColumnRenamed("id", "tracker_id").withColumn("score", F.lit(0.5))
    got = {(r["range"], r["threshold"]): r["ap"] for r in precision.track_precision(o, t, p).collect()}
    assert got["all", 0.8] == pytest.approx(1) and got["all", 0.85] == 0.0 and got["time_l", 0.5] is None and got["time_m", 0.5] == pytest.approx(1) and len(got) == 70


# Regions and boundaries


def dense_boundary(m):
    h, w = m.shape
    out = np.zeros_like(m)
    for y in range(h):
        for x in range(w):
            right, down = x + 1 < w, y + 1 < h
            if right and down:
                out[y, x] = len({m[y, x], m[y, x + 1], m[y + 1, x], m[y + 1, x + 1]}) > 1
            elif right:
                out[y, x] = m[y, x] != m[y, x + 1]
            elif down:
                out[y, x] = m[y, x] != m[y + 1, x]
    return out


def dense_grown(m, r):
    out = np.zeros_like(m)
    for y, x in np.argwhere(m):
        for v in range(max(y - r, 0), min(y + r + 1, m.shape[0])):
            for u in range(max(x - r, 0), min(x + r + 1, m.shape[1])):
                out[v, u] |= (v - y) ** 2 + (u - x) ** 2 <= r * r
    return out


def dense_f(a, b, r):
    p, q = dense_boundary(a), dense_boundary(b)
    if not p.any() or not q.any():
        return 1.0 if p.any() == q.any() else 0.0
    precision, recall = (p & dense_grown(q, r)).sum() / p.sum(), (q & dense_grown(p, r)).sum() / q.sum()
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def test_boundaries_by_intervals_are_those_by_pixels():
    rng = random.Random(14)
    for k in range(80):
        h, w = rng.randint(2, 14), rng.randint(2, 14)
        a, b = (blob(rng, h, w) if k % 8 else np.full((h, w), k % 16 == 0) for _ in range(2))
        got = np.zeros(h * w, bool)
        for x, y in zip(*masks.boundary(masks.encode(a), h, w), strict=True):
            got[x:y] = True
        assert (got.reshape(w, h).T == dense_boundary(a)).all(), (a.astype(int), dense_boundary(a).astype(int))
        for r in (1, 2, 3):
            assert masks.boundary_f(masks.encode(a), masks.encode(b), h, w, r) == pytest.approx(dense_f(a, b, r))


def plain_regions(gt, tr, n, shape, r):
    """Best assignment over all ways, then means over frames; missing masks are empty."""
    import itertools

    none = np.zeros(shape, bool)
    j = lambda a, b: 1.0 if not a.any() and not b.any() else (a & b).sum() / (a | b).sum()
    mean = lambda g, t: np.mean([j(gt[g].get(k, none), tr.get(t, {}).get(k, none)) for k in range(n)])
    names = [*tr, *(f"none{k}" for k in range(max(len(gt) - len(tr), 0)))]
    best = max(itertools.permutations(names, len(gt)), key=lambda way: sum(mean(g, t) for g, t in zip(gt, way, strict=True)))
    out = []
    edges = [int(np.floor(1 + (n - 1) * k / 4 + 0.5 + 1e-10)) - 1 for k in range(5)]
    for g, t in zip(gt, best, strict=True):
        js = np.array([j(gt[g].get(k, none), tr.get(t, {}).get(k, none)) for k in range(n)])
        fs = np.array([dense_f(gt[g].get(k, none), tr.get(t, {}).get(k, none), r) for k in range(n)])
        out.append([v for x in (js, fs) for v in (x.mean(), (x > 0.5).mean(), x[edges[0] : edges[1] + 1].mean() - x[edges[3] : edges[4] + 1].mean())])
    return np.mean(out, axis=0)


def test_region_scores_match_a_plain_version(spark):
    rng = random.Random(31)
    shape, seqs = (9, 11), {}
    for s in range(5):
        gt = {g: {t: m for t in range(7) if rng.random() < 0.8 and (m := blob(rng, *shape)) is not None} for g in range(rng.randint(1, 3))}
        tr = {k: {t: np.roll(m, rng.randint(0, 1), 1) for t, m in gt[k % len(gt)].items() if rng.random() < 0.8} for k in range(rng.randint(0, 4))}
        seqs[s] = ({g: x or {0: blob(rng, *shape)} for g, x in gt.items()}, {k: x for k, x in tr.items() if x})
    rows = lambda side: spark.createDataFrame([(s, i, t, masks.encode(m)) for s, x in seqs.items() for i, track in x[side].items() for t, m in track.items()], "seq long, id long, t long, mask string")
    images = spark.createDataFrame([(s, 7, *shape) for s in seqs], "seq long, n_frames long, h int, w int")
    got = {r["seq"]: [r[c] for c in regions.FIELDS] for r in regions.region_scores(rows(0), rows(1), images).collect()}
    for s, (gt, tr) in seqs.items():
        assert got[s] == pytest.approx(plain_regions(gt, tr, 7, shape, masks.reach_of(*shape))), s
    per = regions.region_scores(rows(0), rows(1), images)
    n = np.array([len(x[0]) for x in seqs.values()])
    assert regions.combined_scores(per).first()["j_mean"] == pytest.approx(sum(got[s][0] * n[s] for s in seqs) / n.sum())
