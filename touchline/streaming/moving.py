"""Trackers under a moving camera: states warped by an affine motion of each frame.

The motion of a frame takes points of the frame before it to this one: x' = a x + b y + c and
y' = d x + e y + f, given as [a, b, c, d, e, f] in a table of video_id, frame, warp, one row a frame.
``with_motion`` puts these rows among the detections, so that a frame without detections moves the
tracks too; the fold of a video meets both in frame order, in batch and as a stream.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..evaluation.assignment import assign, assign_above
from .trackers import GATE, STEPS, Kalman, Step, iou_matrix, moved_boxes, shifts


def with_motion(detections: DataFrame, motion: DataFrame) -> DataFrame:
    """Detections and the motion of frames as one table or stream: rows of a motion have no det_id."""
    kinds = dict(detections.dtypes)
    rest = [c for c in detections.columns if c not in ("video_id", "frame")]
    ticks = motion.select("video_id", "frame", *(F.lit(None).cast(kinds[c]).alias(c) for c in rest), F.col("warp").cast("array<double>").alias("warp"))
    return detections.withColumn("warp", F.lit(None).cast("array<double>")).unionByName(ticks)


class Extent(Kalman):
    """Constant velocity for (x, y, width, height) of many tracks at once; noise in shares of the width and the height."""

    @staticmethod
    def _noise(mean: np.ndarray, p: float, v: float) -> np.ndarray:
        """Variances, on the diagonal."""
        k = Kalman
        return np.square(mean[:, [2, 3] * 4] * np.array([p * k.POSITION] * 4 + [v * k.VELOCITY] * 4))

    @staticmethod
    def start(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([z, np.zeros(z.shape)], axis=1), Extent._noise(z, 2, 10)[:, :, None] * np.eye(8)

    @staticmethod
    def predict(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The constant velocity's matrix adds the second half of rows, then of columns, to the first."""
        noise, mean, cov = Extent._noise(mean, 1, 1), mean.copy(), cov.copy()
        mean[:, :4] += mean[:, 4:]
        cov[:, :4] += cov[:, 4:]
        cov[:, :, :4] += cov[:, :, 4:]
        cov.reshape(-1, 64)[:, ::9] += noise
        return mean, cov

    @staticmethod
    def _seen(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.square(Kalman.POSITION * mean[:, 2:4])
        return mean[:, :4], cov[:, :4, :4] + np.concatenate([s, s], axis=1)[:, :, None] * np.eye(4)

    @staticmethod
    def update(mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, s = Extent._seen(mean, cov)
        gain = np.linalg.solve(s, cov[:, :, :4].transpose(0, 2, 1)).transpose(0, 2, 1)
        return mean + (gain @ (z - m)[:, :, None])[:, :, 0], cov - gain @ s @ gain.transpose(0, 2, 1)

    @staticmethod
    def gate(mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distances of measurements (columns) from tracks (rows)."""
        m, s = Extent._seen(mean, cov)
        d = z[None] - m[:, None]
        return (d * np.linalg.solve(s, d.transpose(0, 2, 1)).transpose(0, 2, 1)).sum(axis=2)

    @staticmethod
    def warped(mean: np.ndarray, cov: np.ndarray, warp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position, extent and their velocities turned by the linear part, the position shifted."""
        if shifts(warp):
            mean = mean.copy()
        else:
            big = np.kron(np.eye(4), warp[:, :2])
            mean, cov = mean @ big.T, big @ cov @ big.T
        mean[:, :2] += warp[:, 2]
        return mean, cov


def _extents(boxes: np.ndarray) -> np.ndarray:
    z = np.empty((len(boxes), 4))
    z[:, :2] = (boxes[:, :2] + boxes[:, 2:]) / 2
    h = z[:, 3] = np.maximum(boxes[:, 3] - boxes[:, 1], 1e-6)
    z[:, 2] = (boxes[:, 2] - boxes[:, 0]) / h * h
    return z


def _length(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=-1, keepdims=True))


def _rest(n: int, used: np.ndarray) -> np.ndarray:
    """The numbers below n that are not used, rising."""
    free = np.ones(n, bool)
    free[used] = False
    return free.nonzero()[0]


def _boxes(mean: np.ndarray) -> np.ndarray:
    return np.concatenate([mean[:, :2] - mean[:, 2:4] / 2, mean[:, :2] + mean[:, 2:4] / 2], axis=1)


#: The tracks of a video, oldest first: an array for each of their values, so that a frame costs a few operations on arrays whatever their number.
Tracks = dict[str, np.ndarray]


def _some(tracks: Tracks, which: np.ndarray) -> Tracks:
    return tracks if which.all() else {k: v[which] for k, v in tracks.items()}


def _with(tracks: Tracks | None, fresh: Tracks) -> Tracks:
    return {k: np.concatenate([tracks[k], v]) for k, v in fresh.items()} if tracks and len(tracks["id"]) else fresh


def _blended(old: np.ndarray, new: np.ndarray, keep: np.ndarray | float) -> np.ndarray:
    mixed = keep * old + (1 - keep) * new
    size = _length(mixed)
    return mixed / np.where(size > 0, size, 1)


def _units(features: np.ndarray) -> np.ndarray:
    norm = _length(features)
    return features / np.where(norm > 0, norm, 1)


def _cosines(known: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Cosine distances; 0 where there are no features."""
    if not unit.shape[1] or not len(known):
        return np.zeros((len(known), len(unit)))
    return np.maximum(0, 1 - known @ unit.T)


def _below(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    if not cost.size:
        return []
    return list(zip(*assign(np.where(cost <= limit, cost, np.nan)), strict=True))


def camera(
    high: float = 0.45, low: float = 0.1, first_cost: float = 0.8, second_cost: float = 0.5, fresh_cost: float = 0.7, new_score: float = 0.6, proximity: float = 0.5, near: float = 0.25,
    blend: float = 0.985, momentum: float = 0.9, twin: float = 0.15, buffer: int = 30,
) -> Step:
    """Appearance blended with motion for confident detections, overlap for weak ones, then tracks seen once.

    Tracks are predicted, then warped by the frame's motion. A track seen once, and not in the video's
    first frame, is neither predicted nor kept when it is missed. Of a followed and a lost track that
    cover each other the one that was followed for longer stays.
    """

    def step(state: dict, frame: int, ids: np.ndarray, boxes: np.ndarray, scores: np.ndarray, features: np.ndarray) -> list[tuple[int, int]]:
        t: Tracks | None = state.get("list")
        if not len(ids) and (t is None or not len(t["id"])):
            return []
        z, unit = _extents(boxes), _units(features)
        if t is None or not len(t["id"]):
            none = np.zeros(0, bool)
            t = {"id": np.zeros(0, np.int64), "mean": np.zeros((0, 8)), "cov": np.zeros((0, 8, 8)), "feature": unit[:0], "start": np.zeros(0, np.int64), "last": np.zeros(0, np.int64), "sure": none, "lost": none}
        else:
            sure = t["sure"]
            t["mean"][sure & t["lost"], 6:] = 0
            mean, cov = Extent.predict(t["mean"], t["cov"])
            if not sure.all():
                mean[~sure], cov[~sure] = t["mean"][~sure], t["cov"][~sure]
            t["mean"], t["cov"] = (mean, cov) if state.get("warp") is None else Extent.warped(mean, cov, state["warp"])
        found: list[tuple[int, int]] = []  # (track, detection), by their places

        def seen(pairs: list[tuple[int, int]], tracks: np.ndarray, detections: np.ndarray, with_feature: bool = True) -> tuple[np.ndarray, np.ndarray]:
            """The pairs' places among the tracks and detections matched; the tracks that were seen move on."""
            at = np.array(pairs, int).reshape(-1, 2)
            i, j = tracks[at[:, 0]], detections[at[:, 1]]
            if len(at):
                t["mean"][i], t["cov"][i] = Extent.update(t["mean"][i], t["cov"][i], z[j])
                if with_feature and unit.shape[1]:
                    t["feature"][i] = _blended(t["feature"][i], unit[j], momentum)
                t["last"][i], t["sure"][i], t["lost"][i] = frame, True, False
                found.extend(zip(i.tolist(), j.tolist(), strict=True))
            return at[:, 0], at[:, 1]

        strong, weak = (scores > high).nonzero()[0], ((scores > low) & (scores < high)).nonzero()[0]
        sure, fresh = (t["sure"]).nonzero()[0], (~t["sure"]).nonzero()[0]
        left, open_ = sure[~t["lost"][sure]], strong
        if len(sure) and len(strong):
            gates = Extent.gate(t["mean"][sure], t["cov"][sure], z[strong])
            cost = blend * _cosines(t["feature"][sure], unit[strong]) + (1 - blend) * gates
            i, j = seen(_below(np.where(gates <= GATE, cost, np.inf), first_cost), sure, strong)
            left = left[t["last"][left] != frame]
            open_ = strong[_rest(len(strong), j)]
        if len(left) and len(weak):
            i, _ = seen(_below(1 - iou_matrix(_boxes(t["mean"][left]), boxes[weak]), second_cost), left, weak, False)
            left = left[_rest(len(left), i)]
        t["lost"][left] = True
        gone = ~t["sure"]  # seen once; those that are missed now go
        if len(fresh) and len(open_):
            overlap = 1 - iou_matrix(_boxes(t["mean"][fresh]), boxes[open_])
            looks = _cosines(t["feature"][fresh], unit[open_]) / 2 if unit.shape[1] else np.ones(overlap.shape)
            looks = np.where((looks > near) | (overlap > proximity), 1.0, looks)
            i, j = seen(_below(np.minimum(1 - (1 - overlap) * scores[open_], looks), fresh_cost), fresh, open_)
            gone[fresh[i]] = False
            open_ = open_[_rest(len(open_), j)]
        out = [(int(ids[j]), int(t["id"][i])) for i, j in found]
        new = open_[scores[open_] >= new_score]
        if len(new):
            names = np.arange(1, len(new) + 1) + state.get("next", 0)
            state["next"] = int(names[-1])
            mean, cov = Extent.start(z[new])
            out += zip(ids[new].tolist(), names.tolist(), strict=True)
            at, first = np.full(len(new), frame), np.full(len(new), frame == state["first"])
            t = _with(t, {"id": names, "mean": mean, "cov": cov, "feature": unit[new], "start": at, "last": at.copy(), "sure": first, "lost": np.zeros(len(new), bool)})
            gone = np.concatenate([gone, np.zeros(len(new), bool)])
        t = _some(t, ~gone & (frame - t["last"] <= buffer))
        followed, lost = (~t["lost"]).nonzero()[0], (t["lost"]).nonzero()[0]
        if len(followed) and len(lost):
            twins = np.argwhere(1 - iou_matrix(_boxes(t["mean"][followed]), _boxes(t["mean"][lost])) < twin)
            if len(twins):
                a, b = followed[twins[:, 0]], lost[twins[:, 1]]
                age, stay = t["last"] - t["start"], np.ones(len(t["id"]), bool)
                stay[np.where(age[a] > age[b], b, a)] = False
                t = _some(t, stay)
        state["list"] = t
        return out

    return step


def _weighed(cosines: np.ndarray, weight: float, bottom: float) -> np.ndarray:
    """Appearance counts less the nearer the second best of a row, and of a column, comes to the best."""
    whole = np.full(cosines.shape, weight)
    for axis in (0, 1):
        if cosines.shape[axis] < 2:
            continue
        ranked = np.sort(cosines, axis=axis)
        best, second = (ranked[-1:], ranked[-2:-1]) if axis == 0 else (ranked[:, -1:], ranked[:, -2:-1])
        ratio = np.divide(second, best, out=np.zeros_like(best), where=best != 0)
        whole = whole * np.where(best == 0, 0.0, 1 - np.maximum(ratio - bottom, 0) / (1 - bottom))
    return whole * cosines


def deep_observation_centric(
    least_score: float = 0.5, least_iou: float = 0.3, inertia: float = 0.2, look_back: int = 3, appearance: float = 0.75, bottom: float = 0.5, momentum: float = 0.95, buffer: int = 30
) -> Step:
    """Overlap, direction and appearance in one cost, then overlap with the last boxes seen; all that is remembered is warped first.

    Appearance is weighed down where it does not tell candidates apart, and averaged with a share that
    falls with the detection's score. Where overlaps alone are one-to-one they decide.
    """

    def middle(b: np.ndarray) -> np.ndarray:
        return (b[..., :2] + b[..., 2:]) / 2

    def way(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = middle(b) - middle(a)
        return d / (_length(d) + 1e-6)

    never = np.iinfo(np.int64).min

    def past(t: Tracks, frame: int) -> np.ndarray:
        """The oldest boxes of the last ``look_back`` frames, else the last ones; a frame's box lies at its number modulo ``look_back``."""
        found = t["box"].copy()
        for back in range(1, look_back + 1):
            k = (frame - back) % look_back
            there = t["at"][:, k] == frame - back
            found[there] = t["seen"][there, k]
        return found

    def step(state: dict, frame: int, ids: np.ndarray, boxes: np.ndarray, scores: np.ndarray, features: np.ndarray) -> list[tuple[int, int]]:
        t: Tracks | None = state.get("list")
        n = len(t["id"]) if t else 0
        if n:
            if state.get("warp") is not None:
                t["mean"], t["cov"] = Extent.warped(t["mean"], t["cov"], state["warp"])
                t["box"] = moved_boxes(t["box"], state["warp"])
                t["seen"] = moved_boxes(t["seen"], state["warp"]).reshape(n, look_back, 4)
            t["mean"], t["cov"] = Extent.predict(t["mean"], t["cov"])
        use, out = (scores > least_score).nonzero()[0], []
        if len(use):
            ids, boxes, scores, unit = ids[use], boxes[use], scores[use], _units(features[use])
            z, keep = _extents(boxes), momentum + (1 - momentum) * (1 - (scores - least_score) / (1 - least_score))
            free_d = np.arange(len(use))
            if n:
                before = past(t, frame)
                overlap = iou_matrix(_boxes(t["mean"]), boxes)
                to = way(before[:, None], boxes[None])
                angle = np.arccos(np.clip(np.einsum("td,tnd->tn", t["heading"], to), -1, 1))
                moving = (t["heading"] != 0).any(axis=1)[:, None]
                worth = overlap + np.where(moving, (np.pi / 2 - angle) / np.pi, 0.0) * inertia * scores
                if unit.shape[1]:
                    worth = worth + _weighed(np.where(overlap > 0, t["feature"] @ unit.T, 0.0), appearance, bottom)
                over = overlap > least_iou
                alone = over.any() and over.sum(0).max() <= 1 and over.sum(1).max() <= 1
                i, j = np.nonzero(over) if alone else assign(-worth)
                close = overlap[i, j] >= least_iou
                i, j = i[close], j[close]
                free_t, free_d = _rest(n, i), _rest(len(use), j)
                if len(free_t) and len(free_d):
                    a, b = assign_above(iou_matrix(t["box"][free_t], boxes[free_d]), least_iou)
                    i, j, free_d = np.concatenate([i, free_t[a]]), np.concatenate([j, free_d[b]]), free_d[_rest(len(free_d), b)]
                if len(i):
                    t["heading"][i] = way(before[i], boxes[j])
                    t["mean"][i], t["cov"][i] = Extent.update(t["mean"][i], t["cov"][i], z[j])
                    t["seen"][i, frame % look_back], t["at"][i, frame % look_back] = boxes[j], frame
                    if unit.shape[1]:
                        t["feature"][i] = _blended(t["feature"][i], unit[j], keep[j][:, None])
                    t["box"][i], t["last"][i] = boxes[j], frame
                    out += zip(ids[j].tolist(), t["id"][i].tolist(), strict=True)
            if len(free_d):
                k = len(free_d)
                names = np.arange(1, k + 1) + state.get("next", 0)
                state["next"] = int(names[-1])
                mean, cov = Extent.start(z[free_d])
                seen, at = np.zeros((k, look_back, 4)), np.full((k, look_back), never)
                seen[:, frame % look_back], at[:, frame % look_back] = boxes[free_d], frame
                fresh = {"id": names, "mean": mean, "cov": cov, "box": boxes[free_d], "seen": seen, "at": at, "heading": np.zeros((k, 2)), "feature": unit[free_d], "last": np.full(k, frame)}
                t = _with(t, fresh)
                out += zip(ids[free_d].tolist(), names.tolist(), strict=True)
        if t:
            state["list"] = _some(t, frame - t["last"] <= buffer)
        return out

    return step


STEPS.update(camera=camera, deep_observation_centric=deep_observation_centric)
