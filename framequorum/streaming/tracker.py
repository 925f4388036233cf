"""SORT tracking: Kalman boxes, optimal matching, ids, and timeouts in processed frames."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..config import TrackRules
from ..operators.assign import match

# The motion model and noise of the tracker whose results these must equal.
MOTION = np.eye(7) + np.diag([1.0, 1.0, 1.0], 4)
SEEN = np.eye(4, 7)
START_NOISE = np.diag([10.0] * 4 + [1e4] * 3)
MOTION_NOISE = np.diag([1.0] * 4 + [0.01, 0.01, 1e-4])
SEEN_NOISE = np.diag([1.0, 1.0, 10.0, 10.0])
OUT = "video_id long, frame_index long, track_id long, x1 int, y1 int, x2 int, y2 int, confidence double, class_id int, hits int, age int"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
TYPES = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in OUT.split(", ")]


def to_state(boxes: np.ndarray) -> np.ndarray:
    """Centre, area and aspect of each box."""
    size = np.maximum(boxes[:, 2:] - boxes[:, :2], 1e-3)
    w, h = size.T
    return np.column_stack([boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, np.maximum(w * h, 1e-6), np.maximum(w / h, 1e-6)])


def to_box(x: np.ndarray) -> np.ndarray:
    s, r = np.maximum(x[:, 2], 1e-6), np.maximum(x[:, 3], 1e-6)
    w = (s * r) ** 0.5
    h = np.where(w > 1e-9, s / np.maximum(w, 1e-9), 1e-3)
    return np.column_stack([x[:, 0] - w / 2, x[:, 1] - h / 2, x[:, 0] + w / 2, x[:, 1] + h / 2])


class Seen(NamedTuple):
    """A track as one frame shows it."""

    number: int
    x1: int
    y1: int
    x2: int
    y2: int
    confidence: float
    class_id: int
    hits: int
    age: int


@dataclass
class Tracker:
    """Frames in order; each gives the tracks seen now and confirmed by a streak of hits.

    The live tracks are rows of arrays, in the order of their numbers: the filter steps all
    of them at once. Counts are the columns hits, streak, age, missed.
    """

    rules: TrackRules = field(default_factory=TrackRules)
    next_number: int = 1
    number: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    x: np.ndarray = field(default_factory=lambda: np.zeros((0, 7)))
    p: np.ndarray = field(default_factory=lambda: np.zeros((0, 7, 7)))
    confidence: np.ndarray = field(default_factory=lambda: np.zeros(0))
    class_id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))

    @property
    def tracks(self) -> list[int]:
        return self.number.tolist()

    def _predict(self) -> np.ndarray:
        self.x[self.x[:, 2] + self.x[:, 6] <= 0, 6] = 0.0
        self.x = self.x @ MOTION.T
        self.p = MOTION @ self.p @ MOTION.T + MOTION_NOISE
        self.counts[self.counts[:, 3] > 0, 1] = 0
        self.counts[:, 2:] += 1
        return np.rint(to_box(self.x))

    def _start(self, boxes: np.ndarray) -> None:
        n = len(boxes)
        self.number = np.r_[self.number, self.next_number + np.arange(n)]
        self.next_number += n
        self.x = np.vstack([self.x, np.column_stack([to_state(boxes), np.zeros((n, 3))])])
        self.p = np.concatenate([self.p, np.broadcast_to(START_NOISE, (n, 7, 7))])
        self.confidence, self.class_id = np.r_[self.confidence, np.ones(n)], np.r_[self.class_id, np.full(n, -1)]
        self.counts = np.vstack([self.counts, np.zeros((n, 4), np.int64)])

    def _update(self, rows: np.ndarray, boxes: np.ndarray, confidence: np.ndarray, classes: np.ndarray) -> None:
        x, p = self.x[rows], self.p[rows]
        s = SEEN @ p @ SEEN.T + SEEN_NOISE
        try:
            inverse = np.linalg.inv(s)
        except np.linalg.LinAlgError:
            inverse = np.linalg.pinv(s)
        gain = p @ SEEN.T @ inverse
        self.x[rows] = x + (gain @ (to_state(boxes) - x @ SEEN.T)[:, :, None])[:, :, 0]
        self.p[rows] = (np.eye(7) - gain @ SEEN) @ p
        self.confidence[rows], self.class_id[rows] = confidence, classes
        self.counts[rows, :2] += 1
        self.counts[rows, 3] = 0

    def step(self, boxes: np.ndarray, confidence: np.ndarray, classes: np.ndarray) -> list[Seen]:
        pairs = match(boxes, self._predict(), self.rules.iou_threshold)
        old = len(self.number)
        taken, rows = (np.array([pair[side] for pair in pairs], np.int64) for side in (0, 1))
        fresh = np.setdiff1d(np.arange(len(boxes)), taken)
        self._start(boxes[fresh])
        at = np.r_[taken, fresh]
        if len(at):
            self._update(np.r_[rows, old + np.arange(len(fresh))], boxes[at], confidence[at], classes[at])
        shown = np.flatnonzero((self.counts[:, 3] == 0) & (self.counts[:, 1] >= self.rules.min_hits))
        corners = np.rint(to_box(self.x[shown])).astype(np.int64)
        columns = (self.number[shown], *corners.T, self.confidence[shown], self.class_id[shown], self.counts[shown, 0], self.counts[shown, 2])
        out = [Seen(*row) for row in zip(*(c.tolist() for c in columns), strict=True)]
        live = self.counts[:, 3] <= self.rules.max_age
        if not live.all():
            for name in ("number", "x", "p", "confidence", "class_id", "counts"):
                setattr(self, name, getattr(self, name)[live])
        return out


def _steps(tracker: Tracker, video: int | None, rows: pa.Table) -> list[tuple]:
    """Output rows of a video's next frames; rows come in order of frame and ord. A missing class counts as -1."""
    frames = rows.column("frame_index").to_pylist()
    boxes = np.column_stack([rows.column(c).to_numpy().astype(float) for c in ("x1", "y1", "x2", "y2")])
    confidence = rows.column("confidence").to_numpy().astype(float)
    classes = rows.column("class_id").fill_null(-1).to_numpy().astype(np.int64)
    real = ~np.isnan(boxes[:, 0])
    cuts = [0, *(i for i in range(1, len(frames)) if frames[i] != frames[i - 1]), len(frames)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        here = a + np.flatnonzero(real[a:b])
        out += [(video, frames[a], *seen) for seen in tracker.step(boxes[here], confidence[here], classes[here])]
    return out


def _track_videos(rules: TrackRules):
    """Arrow batches in order of video, frame and ord; only the last frame, which may go on, waits for the next batch."""

    def run(batches):
        tracker, video, rest = Tracker(rules), None, None
        for batch in itertools.chain(batches, [None]):
            rows = rest if batch is None else pa.Table.from_batches([batch])
            if batch is not None and rest is not None:
                rows = pa.concat_tables([rest, rows])
            if rows is None or not rows.num_rows:
                continue
            keys = list(zip(rows.column("video_id").to_pylist(), rows.column("frame_index").to_pylist(), strict=True))
            end = len(keys) if batch is None else next((i + 1 for i in range(len(keys) - 1, -1, -1) if keys[i] != keys[-1]), 0)
            cuts = [0, *(i for i in range(1, end) if keys[i][0] != keys[i - 1][0]), end]
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if keys[a][0] != video:
                        tracker, video = Tracker(rules), keys[a][0]
                    out += _steps(tracker, video, rows.slice(a, b - a))
            rest = rows.slice(end)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=COLUMNS)

    return run


def _wanted(detections: DataFrame, rules: TrackRules) -> DataFrame:
    """Detections of the wanted classes, and the rows that stand for frames without detections."""
    return detections.where(F.col("class_id").isin(*rules.classes) | F.col("x1").isNull()) if rules.classes else detections


def track(detections: DataFrame, rules: TrackRules = TrackRules()) -> DataFrame:
    """Confirmed tracks per frame. A video is one ordered state; videos run in parallel.

    Rows are sorted, with spill, and go through in Arrow batches: a task holds the live tracks
    of one video, however long it is.

    detections: video_id, frame_index, ord, x1..y2, confidence, class_id; a frame without
    detections is a row with null corners, or is not counted as processed.
    """
    columns = ("video_id", "frame_index", "ord", "x1", "y1", "x2", "y2", "confidence", "class_id")
    rows = _wanted(detections, rules).select(*columns).repartition("video_id").sortWithinPartitions("video_id", "frame_index", "ord")
    return rows.mapInArrow(_track_videos(rules), OUT)


def untracked(detections: DataFrame) -> DataFrame:
    """Tracking off: every detection is its own confirmed track, numbered in (frame, ord) order within its video."""
    from pyspark.sql import Window

    by = Window.partitionBy("video_id").orderBy("frame_index", "ord")
    return detections.withColumn("track_id", F.row_number().over(by).cast("long"))


def stream_function(rules: TrackRules = TrackRules()):
    """State function for ``applyInPandasWithState``: a pickled tracker per video, frames of a batch in order.

    Frames at or before the last one processed are late and dropped. A track goes after
    ``max_age`` processed frames without it, as in ``track``; wall time plays no part, and the
    state that stays (live tracks and the next number) does not grow with the video.
    """
    import pickle

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tracker, last = pickle.loads(state.get[0]) if state.exists else (Tracker(rules), None)
        rows = pd.concat([p for p in parts if len(p)]).sort_values(["frame_index", "ord"], kind="stable")
        if last is not None:
            rows = rows[rows["frame_index"] > last]
        out = _steps(tracker, key[0], pa.Table.from_pandas(rows, preserve_index=False))
        state.update((pickle.dumps((tracker, last if rows.empty else int(rows["frame_index"].iloc[-1]))),))
        yield pd.DataFrame(out, columns=COLUMNS)

    return run


def track_stream(detections: DataFrame, rules: TrackRules = TrackRules()) -> DataFrame:
    """Streaming form of ``track``; frames without detections count as processed, as there."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return _wanted(detections, rules).groupBy("video_id").applyInPandasWithState(stream_function(rules), OUT, "state binary", "append", GroupStateTimeout.NoTimeout)
