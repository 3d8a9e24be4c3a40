"""Videos as keyed state with a life: buffered until the watermark, closed when idle, then gone.

Detections carry their event time. What arrives is held in the state store until the watermark has
passed it, so frames are folded in order although they arrive out of order; rows behind the watermark
are dropped by Spark and counted in the query's progress, and ``late_rows`` reads that count. A timer
closes a video that has been silent for a while: its last frames are folded, one closing row is
given, and its state and timers are removed, so that the store holds open videos only. State is
versioned with the checkpoint: a restart goes on where the last batch ended and repeats nothing.

The session must use the RocksDB state store (``SETTINGS``).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .trackers import _fold, _step

SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUTPUT = "video_id string, kind string, frame long, det_id long, track_id long, n_frames long, n_detections long, n_tracks long"
_COLUMNS = ["video_id", "kind", "frame", "det_id", "track_id", "n_frames", "n_detections", "n_tracks"]
_ROW = "frame long, at_ms long, det_id long, box array<double>, score double"


class VideoLife(StatefulProcessor):
    """One video: detections that wait for the watermark, and the tracker's state."""

    def __init__(self, tracker: str, options: dict[str, Any], idle_ms: int):
        self.tracker, self.options, self.idle_ms = tracker, options, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.step = handle, _step(self.tracker, self.options)
        self.waiting = handle.getListState("waiting", _ROW)
        self.state = handle.getValueState("state", "state binary, last_ms long")

    def _held(self) -> tuple[dict, int | None]:
        """The tracker's state and the time of the last frame folded."""
        if not self.state.exists():
            return {"counts": [0, 0], "ids": set()}, None
        packed, last = self.state.get()
        return pickle.loads(packed), last

    def _advance(self, key: tuple, fresh: list[tuple], mark: int) -> list[tuple]:
        """Fold the frames that the watermark has passed; hold the others; close after silence."""
        rows = sorted([tuple(r) for r in self.waiting.get()] + fresh, key=lambda r: (r[1], r[2]))
        held, last = self._held()
        ready, later = [r for r in rows if r[1] <= mark], [r for r in rows if r[1] > mark]
        out = []

        def closing() -> tuple:
            return (key[0], "closed", held.get("frame"), None, None, *held["counts"], len(held["ids"]))

        while ready:
            if last is not None and ready[0][1] - last > self.idle_ms:
                out.append(closing())
                held, last = {"counts": [0, 0], "ids": set()}, None
            end = next((k for k in range(1, len(ready)) if ready[k][1] - ready[k - 1][1] > self.idle_ms), len(ready))
            pdf = pd.DataFrame([(r[0], r[2], list(r[3]), r[4]) for r in ready[:end]], columns=["frame", "det_id", "box", "score"])
            found = _fold(self.step, held, pdf)
            held["counts"] = [held["counts"][0] + pdf["frame"].nunique(), held["counts"][1] + len(pdf)]
            held["ids"] |= {t for _, _, t in found}
            out += [(key[0], "track", f, d, t, None, None, None) for f, d, t in found]
            last, ready = ready[end - 1][1], ready[end:]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is not None and mark >= last + self.idle_ms:
            out.append(closing())
            last = None
        if last is None:
            self.state.clear()
        else:
            self.state.update((pickle.dumps(held), last))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        times = [*([last + self.idle_ms] if last is not None else []), *(r[1] for r in later)]
        if times:
            self.handle.registerTimer(min(times))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = []
        for pdf in rows:
            fresh += [(int(f), int(a), int(d), [float(v) for v in b], float(s)) for f, a, d, b, s in zip(pdf["frame"], pdf["at_ms"], pdf["det_id"], pdf["box"], pdf["score"], strict=True)]
        yield _frame(self._advance(key, fresh, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield _frame(self._advance(key, [], timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=_COLUMNS)
    return pdf.astype({c: "Int64" for c in _COLUMNS[2:]})


def tracked_videos(detections: DataFrame, at: str, tracker: str = "two_stage", late: str = "5 seconds", idle_ms: int = 30_000, **options: Any) -> DataFrame:
    """A stream of 'track' rows and, once a video has been silent for ``idle_ms`` of event time, its 'closed' row.

    ``detections`` has video_id, frame, det_id, box, score and the timestamp ``at``, the same for all rows of a
    frame and rising with frames; ``late`` is how far rows may come out of order. A closed video that speaks
    again is a new one. Frames, detections and tracks of a video are counted in its closing row.
    """
    rows = detections.withWatermark(at, late).select("video_id", "frame", F.unix_millis(at).alias("at_ms"), "det_id", "box", "score", at)
    grouped = rows.where("video_id is not null and frame is not null and det_id is not null and box is not null").groupBy("video_id")
    return grouped.transformWithStateInPandas(statefulProcessor=VideoLife(tracker, options, idle_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def late_rows(query: Any) -> int:
    """Rows that a running or ended query has dropped because they came behind the watermark."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def held_rows(query: Any) -> int:
    """Rows of state, timers included, that the store holds after the last batch: some for each open video."""
    last = [p for p in query.recentProgress if p["stateOperators"]]
    return int(last[-1]["stateOperators"][0]["numRowsTotal"]) if last else 0
