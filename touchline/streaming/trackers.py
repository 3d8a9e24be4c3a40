"""Online trackers as folds over frames, run in batch or as keyed streaming state.

A tracker is a plain state and a step function for one frame. ``track_batch`` folds whole videos;
``track_stream`` keeps the state of each video between micro-batches. Both give the same rows as long
as a video's frames arrive in order; frames that arrive late, at or before the last one, are dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..evaluation.assignment import assign
from ..operators import frames

#: (state, frame, ids, boxes, scores, features) to (detection, track) pairs; features has no columns where there are none.
Step = Callable[[dict, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[tuple[int, int]]]
OUTPUT = "video_id string, frame long, det_id long, track_id long"


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of ltrb rows; degenerate boxes give 0."""
    apart = np.maximum(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0)
    common = apart[:, :, 0] * apart[:, :, 1]
    sides_a, sides_b = np.maximum(a[:, 2:] - a[:, :2], 0), np.maximum(b[:, 2:] - b[:, :2], 0)
    union = (sides_a[:, 0] * sides_a[:, 1])[:, None] + sides_b[:, 0] * sides_b[:, 1] - common
    return np.divide(common, union, out=np.zeros(union.shape), where=union > 0)


class Kalman:
    """Constant velocity for (x, y, aspect, height); noise in shares of the height."""

    #: Shares of the height: fixed values.
    POSITION, VELOCITY = 1 / 20, 1 / 160

    @staticmethod
    def _noise(h: float, p: float, v: float) -> np.ndarray:
        k = Kalman
        return np.diag(np.square([p * k.POSITION * h, p * k.POSITION * h, 1e-2, p * k.POSITION * h, v * k.VELOCITY * h, v * k.VELOCITY * h, 1e-5, v * k.VELOCITY * h]))

    @staticmethod
    def start(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([z, np.zeros(4)]), Kalman._noise(z[3], 2, 10)

    @staticmethod
    def predict(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = np.eye(8) + np.eye(8, k=4)
        return f @ mean, f @ cov @ f.T + Kalman._noise(mean[3], 1, 1)

    @staticmethod
    def _seen(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = Kalman.POSITION * mean[3]
        return mean[:4], cov[:4, :4] + np.diag(np.square([s, s, 1e-1, s]))

    @staticmethod
    def update(mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, s = Kalman._seen(mean, cov)
        gain = np.linalg.solve(s, cov[:, :4].T).T
        return mean + gain @ (z - m), cov - gain @ s @ gain.T

    @staticmethod
    def gate(mean: np.ndarray, cov: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distances of measurements."""
        m, s = Kalman._seen(mean, cov)
        d = z - m
        return np.einsum("ij,ij->i", d, np.linalg.solve(s, d.T).T)


def shifts(warp: np.ndarray) -> bool:
    """Whether a motion only shifts."""
    return warp[0, 0] == 1 and warp[1, 1] == 1 and warp[0, 1] == 0 and warp[1, 0] == 0


def moved_boxes(boxes: np.ndarray, warp: np.ndarray) -> np.ndarray:
    """ltrb rows with both corners taken through an affine motion (2 x 3)."""
    if shifts(warp):
        return boxes.reshape(-1, 4) + np.concatenate([warp[:, 2], warp[:, 2]])
    corners = boxes.reshape(-1, 2) @ warp[:, :2].T + warp[:, 2]
    return corners.reshape(-1, 4)


def _advanced(state: dict, t: dict, predict: bool = True) -> None:
    """A track's next state, under the frame's camera motion if there is one: heights grow with the square root of the area."""
    if predict:
        t["mean"], t["cov"] = Kalman.predict(t["mean"], t["cov"])
    if state.get("warp") is not None:
        turn = state["warp"][:, :2]
        big = np.kron(np.eye(4), np.zeros((2, 2)))
        for k in (0, 4):
            big[k : k + 2, k : k + 2] = turn
            big[k + 2, k + 2], big[k + 3, k + 3] = 1, np.sqrt(abs(np.linalg.det(turn)))
        t["mean"] = big @ t["mean"]
        t["mean"][:2] += state["warp"][:, 2]
        t["cov"] = big @ t["cov"] @ big.T


def _measure(boxes: np.ndarray) -> np.ndarray:
    w, h = boxes[:, 2] - boxes[:, 0], np.maximum(boxes[:, 3] - boxes[:, 1], 1e-6)
    return np.column_stack([(boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2, w / h, h])


def _box(mean: np.ndarray) -> np.ndarray:
    w = mean[2] * mean[3]
    return np.array([mean[0] - w / 2, mean[1] - mean[3] / 2, mean[0] + w / 2, mean[1] + mean[3] / 2])


def propagation(least_iou: float = 0.5, decay: float = 0.1, most_age: int = 7) -> Step:
    """Match to last boxes by IoU times decay**age; tracks go after ``most_age`` frames."""

    def step(state: dict, frame: int, ids: np.ndarray, boxes: np.ndarray, scores: np.ndarray, features: np.ndarray) -> list[tuple[int, int]]:
        tracks = {k: t for k, t in state.setdefault("tracks", {}).items() if frame - t[1] <= most_age}
        if state.get("warp") is not None:
            tracks = {k: (moved_boxes(b[None], state["warp"])[0], f) for k, (b, f) in tracks.items()}
        names = sorted(tracks)
        out, used = [], {}
        if names and len(ids):
            m = iou_matrix(np.array([tracks[k][0] for k in names]), boxes)
            aged = m * np.array([decay ** (frame - tracks[k][1] - 1) for k in names])[:, None]
            ok = m >= least_iou
            for i, j in zip(*assign(-np.where(ok, aged, 0)), strict=True):
                if ok[i, j]:
                    used[j] = names[i]
        for j, d in enumerate(ids):
            if j not in used:
                state["next"] = state.get("next", 0) + 1
                used[j] = state["next"]
            tracks[used[j]] = (boxes[j], frame)
            out.append((int(d), used[j]))
        state["tracks"] = tracks
        return out

    return step


def two_stage(high: float = 0.5, low: float = 0.1, first_cost: float = 0.8, second_cost: float = 0.5, new_cost: float = 0.7, buffer: int = 30) -> Step:
    """Confident detections first, then weak ones to tracks that are still open; Kalman boxes.

    A track starts from a detection of at least high + 0.1; one that was seen once and is missed at
    once goes; lost tracks go after ``buffer`` frames.
    """

    def match(tracks: list[dict], boxes: np.ndarray, limit: float, scores: np.ndarray | None) -> list[tuple[int, int]]:
        if not tracks or not len(boxes):
            return []
        cost = 1 - iou_matrix(np.array([_box(t["mean"]) for t in tracks]), boxes)
        if scores is not None:
            cost = 1 - (1 - cost) * scores
        return [(i, j) for i, j in zip(*assign(np.where(cost <= limit, cost, np.nan)), strict=True)]

    def step(state: dict, frame: int, ids: np.ndarray, boxes: np.ndarray, scores: np.ndarray, features: np.ndarray) -> list[tuple[int, int]]:
        tracks: list[dict] = state.setdefault("list", [])
        for t in tracks:
            _advanced(state, t)
        z, out = _measure(boxes), []

        def seen(t: dict, j: int) -> None:
            t["mean"], t["cov"] = Kalman.update(t["mean"], t["cov"], z[j])
            t.update(last=frame, hits=t["hits"] + 1, lost=False)
            out.append((int(ids[j]), t["id"]))

        strong, weak = np.flatnonzero(scores >= high), np.flatnonzero((scores >= low) & (scores < high))
        sure = [t for t in tracks if t["hits"] > 1 or t["start"] == state["first"]]
        fresh = [t for t in tracks if not any(t is s for s in sure)]
        a = match(sure, boxes[strong], first_cost, scores[strong])
        for i, j in a:
            seen(sure[i], strong[j])
        left = [sure[i] for i in range(len(sure)) if i not in {x for x, _ in a} and not sure[i]["lost"]]
        b = match(left, boxes[weak], second_cost, None)
        for i, j in b:
            seen(left[i], weak[j])
        open_ = np.array([j for k, j in enumerate(strong) if k not in {y for _, y in a}], int)
        c = match(fresh, boxes[open_], new_cost, scores[open_])
        for i, j in c:
            seen(fresh[i], open_[j])
        gone = {id(fresh[i]) for i in range(len(fresh)) if i not in {x for x, _ in c}}
        for t in left:
            t["lost"] = t["last"] != frame
        for k, j in enumerate(open_):
            if k not in {y for _, y in c} and scores[j] >= high + 0.1:
                state["next"] = state.get("next", 0) + 1
                mean, cov = Kalman.start(z[j])
                tracks.append({"id": state["next"], "mean": mean, "cov": cov, "start": frame, "last": frame, "hits": 1, "lost": False})
                out.append((int(ids[j]), state["next"]))
        state["list"] = [t for t in tracks if id(t) not in gone and frame - t["last"] <= buffer]
        return out

    return step


def observation_centric(least_score: float = 0.5, least_iou: float = 0.3, inertia: float = 0.2, look_back: int = 3, buffer: int = 30) -> Step:
    """Overlap with predicted boxes plus agreement of directions, then overlap with the last boxes seen.

    The direction of a track is that from an observation ``look_back`` frames ago to its last one; a
    candidate is favoured by the cosine between it and the way from that observation to the candidate.
    """

    def direction(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (b[..., :2] + b[..., 2:] - a[..., :2] - a[..., 2:]) / 2
        return d / np.maximum(np.linalg.norm(d, axis=-1, keepdims=True), 1e-6)

    def past(t: dict) -> np.ndarray:
        frames = sorted(t["seen"])
        old = [f for f in frames if f <= frames[-1] - look_back]
        return t["seen"][old[-1] if old else frames[0]]

    def step(state: dict, frame: int, ids: np.ndarray, boxes: np.ndarray, scores: np.ndarray, features: np.ndarray) -> list[tuple[int, int]]:
        tracks: list[dict] = state.setdefault("list", [])
        for t in tracks:
            _advanced(state, t)
            if state.get("warp") is not None:
                t["seen"] = {f: moved_boxes(b[None], state["warp"])[0] for f, b in t["seen"].items()}
        use = np.flatnonzero(scores >= least_score)
        z, out, free_t, free_d = _measure(boxes), [], list(range(len(tracks))), list(use)

        def take(i: int, j: int) -> None:
            t = tracks[i]
            t["mean"], t["cov"] = Kalman.update(t["mean"], t["cov"], z[j])
            t["seen"] = {f: b for f, b in t["seen"].items() if f >= frame - 2 * look_back} | {frame: boxes[j]}
            t["last"] = frame
            free_t.remove(i)
            free_d.remove(j)
            out.append((int(ids[j]), t["id"]))

        if free_t and free_d:
            overlap = iou_matrix(np.array([_box(t["mean"]) for t in tracks]), boxes[use])
            way = np.array([direction(past(t), t["seen"][max(t["seen"])]) for t in tracks])
            to = np.array([direction(past(t), boxes[use]) for t in tracks])
            cost = -(overlap + inertia * np.einsum("td,tnd->tn", way, to) * scores[use])
            for i, j in zip(*assign(np.where(overlap >= least_iou, cost, np.nan)), strict=True):
                take(i, use[j])
        if free_t and free_d:
            rest_t, rest_d = list(free_t), list(free_d)
            overlap = iou_matrix(np.array([tracks[i]["seen"][max(tracks[i]["seen"])] for i in rest_t]), boxes[rest_d])
            for i, j in zip(*assign(np.where(overlap >= least_iou, -overlap, np.nan)), strict=True):
                take(rest_t[i], rest_d[j])
        for j in list(free_d):
            state["next"] = state.get("next", 0) + 1
            mean, cov = Kalman.start(z[j])
            tracks.append({"id": state["next"], "mean": mean, "cov": cov, "seen": {frame: boxes[j]}, "last": frame})
            out.append((int(ids[j]), state["next"]))
        state["list"] = [t for t in tracks if frame - t["last"] <= buffer]
        return out

    return step


#: The 0.95 quantile of chi-square with four degrees of freedom: a fixed value.
GATE = 9.4877


def part_distances(a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    """Half the distance of unit vectors, the mean over parts weighed by the visibility of both; 1 where no part is visible in both.

    Rows hold the visibility of each part, then the parts' vectors one after the other.
    """
    va, vb = a[:, :parts], b[:, :parts]
    x, y = (m[:, parts:].reshape(len(m), parts, -1) for m in (a, b))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=2, keepdims=True), 1e-12)
    apart = np.sqrt(np.maximum(2 - 2 * np.einsum("ipd,jpd->ijp", unit(x), unit(y)), 0)) / 2
    weight = va[:, None, :] * vb[None, :, :]
    total = weight.sum(axis=2)
    return np.where(total > 0, (apart * weight).sum(axis=2) / np.where(total > 0, total, 1), 1.0)


def _blended_parts(old: np.ndarray, new: np.ndarray, parts: int, momentum: float) -> np.ndarray:
    """Parts seen in both are averaged exponentially, parts seen in one are its own; what was seen once stays visible."""
    v, w = old[:parts], new[:parts]
    x, y = old[parts:].reshape(parts, -1), new[parts:].reshape(parts, -1)
    share = np.where((v > 0) & (w > 0), momentum, (v > 0).astype(float))[:, None]
    return np.concatenate([np.maximum(v, w), (share * x + (1 - share) * y).ravel()])


def appearance(most_cosine: float = 0.3, least_iou: float = 0.3, momentum: float = 0.9, blind: int = 7, first_hits: int = 1, buffer: int = 300, parts: int = 0) -> Step:
    """Confirmed tracks by appearance within the motion gate, then overlap for the rest.

    Features are averaged exponentially and kept at unit length; a lost track is predicted for at most
    ``blind`` frames; found after that it starts to move anew. With ``parts``, features are the visibility
    of so many body parts and then their vectors: only parts visible in both are compared and averaged.
    """

    def step(state: dict, frame: int, ids: np.ndarray, boxes: np.ndarray, scores: np.ndarray, features: np.ndarray) -> list[tuple[int, int]]:
        tracks: list[dict] = state.setdefault("list", [])
        for t in tracks:
            _advanced(state, t, frame - t["last"] <= blind)
        norm = np.linalg.norm(features, axis=1, keepdims=True)
        unit = features if parts else features / np.where(norm > 0, norm, 1)
        z, out, free_t, free_d = _measure(boxes), [], list(range(len(tracks))), list(range(len(ids)))

        def take(i: int, j: int) -> None:
            t = tracks[i]
            t["mean"], t["cov"] = Kalman.start(z[j]) if frame - t["last"] > blind else Kalman.update(t["mean"], t["cov"], z[j])
            blend = _blended_parts(t["feature"], unit[j], parts, momentum) if parts else momentum * t["feature"] + (1 - momentum) * unit[j]
            size = np.linalg.norm(blend)
            t.update(feature=blend / size if size > 0 and not parts else blend, last=frame, hits=t["hits"] + 1)
            free_t.remove(i)
            free_d.remove(j)
            out.append((int(ids[j]), t["id"]))

        sure = [i for i in free_t if tracks[i]["hits"] >= first_hits]
        if sure and free_d and unit.shape[1]:
            known = np.array([tracks[i]["feature"] for i in sure])
            cost = part_distances(known, unit, parts) if parts else np.maximum(0, 1 - known @ unit.T)
            gate = np.array([Kalman.gate(tracks[i]["mean"], tracks[i]["cov"], z) for i in sure])
            near = (gate <= GATE) | (np.array([frame - tracks[i]["last"] for i in sure]) > blind)[:, None]
            for i, j in zip(*assign(np.where((cost <= most_cosine) & near, cost, np.nan)), strict=True):
                take(sure[i], j)
        rest_t, rest_d = [i for i in free_t if frame - tracks[i]["last"] <= blind], list(free_d)
        if rest_t and rest_d:
            overlap = iou_matrix(np.array([_box(tracks[i]["mean"]) for i in rest_t]), boxes[rest_d])
            for i, j in zip(*assign(np.where(overlap >= least_iou, -overlap, np.nan)), strict=True):
                take(rest_t[i], rest_d[j])
        for j in list(free_d):
            state["next"] = state.get("next", 0) + 1
            mean, cov = Kalman.start(z[j])
            tracks.append({"id": state["next"], "mean": mean, "cov": cov, "feature": unit[j], "last": frame, "hits": 1})
            out.append((int(ids[j]), state["next"]))
        state["list"] = [t for t in tracks if frame - t["last"] <= buffer]
        return out

    return step


def pitch(most_metres: float = 5.0, most_cosine: float = 0.4, weight: float = 0.5, momentum: float = 0.9, buffer: int = 50) -> Step:
    """Positions on the pitch: metres and appearance in one cost, both gated; boxes are points (x, y, x, y)."""

    def step(state: dict, frame: int, ids: np.ndarray, boxes: np.ndarray, scores: np.ndarray, features: np.ndarray) -> list[tuple[int, int]]:
        tracks: list[dict] = state.setdefault("list", [])
        at = (boxes[:, :2] + boxes[:, 2:]) / 2
        norm = np.linalg.norm(features, axis=1, keepdims=True)
        unit = features / np.where(norm > 0, norm, 1)
        out, taken = [], set()
        if tracks and len(ids):
            metres = np.linalg.norm(np.array([t["at"] for t in tracks])[:, None] - at[None], axis=2)
            cost, ok = metres / most_metres, metres <= most_metres
            if unit.shape[1]:
                cosine = np.maximum(0, 1 - np.array([t["feature"] for t in tracks]) @ unit.T)
                cost, ok = weight * cost + (1 - weight) * cosine / most_cosine, ok & (cosine <= most_cosine)
            for i, j in zip(*assign(np.where(ok, cost, np.nan)), strict=True):
                t = tracks[i]
                t.update(at=at[j], last=frame, feature=momentum * t["feature"] + (1 - momentum) * unit[j])
                taken.add(j)
                out.append((int(ids[j]), t["id"]))
        for j in range(len(ids)):
            if j not in taken:
                state["next"] = state.get("next", 0) + 1
                tracks.append({"id": state["next"], "at": at[j], "feature": unit[j], "last": frame})
                out.append((int(ids[j]), state["next"]))
        state["list"] = [t for t in tracks if frame - t["last"] <= buffer]
        return out

    return step


STEPS: dict[str, Callable[..., Step]] = {
    "propagation": propagation, "two_stage": two_stage, "observation_centric": observation_centric, "appearance": appearance, "pitch": pitch,
}


def _step(tracker: str, options: dict) -> Step:
    from . import moving  # noqa: F401  registers its trackers

    return STEPS[tracker](**options)


def _fold(step: Step, state: dict, pdf: pd.DataFrame) -> list[tuple[int, int, int]]:
    pdf = pdf[pdf["frame"].notna()].sort_values(["frame", "det_id"], kind="stable")
    at, is_box = pdf["frame"].to_numpy(np.int64), np.ones(len(pdf), bool)
    warps = [None] * len(pdf)
    if "warp" in pdf:  # rows without a detection bring the motion of the camera
        warps, is_box = pdf["warp"].tolist(), pdf["det_id"].notna().to_numpy()
    found = pdf[is_box]
    ids, scores = found["det_id"].to_numpy(np.int64), found["score"].to_numpy(float)
    boxes = np.array(found["box"].tolist(), float).reshape(-1, 4)
    seen = np.array(found["features"].tolist(), float).reshape(len(found), -1) if "features" in found and len(found) else None
    firsts = np.flatnonzero(np.diff(at, prepend=at[:1] - 1))  # where a frame begins
    ends, place = np.append(firsts[1:], len(at)), np.concatenate([[0], np.cumsum(is_box)])
    rows = []
    for i, e, frame in zip(firsts.tolist(), ends.tolist(), at[firsts].tolist(), strict=True):
        if frame <= state.get("frame", -1):
            continue  # late
        state["frame"] = frame
        a, b = int(place[i]), int(place[e])
        if "warp" in pdf:
            motion = next((w for w in warps[i:e] if w is not None), None)
            state["warp"] = None if motion is None else np.array(motion, float).reshape(2, 3)
        if a < b:
            state.setdefault("first", frame)
        elif "first" not in state:
            continue
        features = np.zeros((b - a, state.get("width", 0)))
        if seen is not None and a < b:
            features = seen[a:b]
            state["width"] = features.shape[1]
        rows += [(frame, d, t) for d, t in step(state, frame, ids[a:b], boxes[a:b], scores[a:b], features)]
    return rows


def _columns(detections: DataFrame) -> list[str]:
    return ["video_id", "frame", "det_id", "box", "score", *(c for c in ("features", "warp") if c in detections.columns)]


def track_batch(detections: DataFrame, tracker: str = "propagation", **options: Any) -> DataFrame:
    """video_id, frame, det_id, track_id of whole videos; detections have det_id, box (ltrb), score and, for trackers
    that look at appearance, features (array<double> of one length); ``moving.with_motion`` adds the camera's motion."""
    step = _step(tracker, options)

    def some(state: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["video_id"].iloc[0], *r) for r in _fold(step, state, pdf)], columns=["video_id", "frame", "det_id", "track_id"])

    return frames.fold(detections.select(*_columns(detections)), "video_id", "frame", dict, some, OUTPUT)


def track_stream(detections: DataFrame, tracker: str = "propagation", **options: Any) -> DataFrame:
    """The same over a stream; the state of a video survives restarts with the checkpoint."""
    step = _step(tracker, options)

    def fold(key: tuple[str], frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = pickle.loads(held.get[0]) if held.exists else {}
        pdf = pd.concat(list(frames))
        rows = _fold(step, state, pdf)
        held.update((pickle.dumps(state),))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["video_id", "frame", "det_id", "track_id"])

    return (
        detections.select(*_columns(detections))
        .groupBy("video_id")
        .applyInPandasWithState(fold, OUTPUT, "state binary", "append", GroupStateTimeout.NoTimeout)
    )
