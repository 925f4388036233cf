"""Boxes against boxes: overlaps, optimal pairs, and plates to vehicles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geometry as G

KEY = ("video_id", "frame_index")
EDGES = ("x1", "y1", "x2", "y2")


def _box(prefix: str) -> G.Box:
    return tuple(F.col(f"{prefix}{e}") for e in EDGES)


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*KEY, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in KEY])


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """IoU of every pair of boxes of one frame (columns a_*, b_*): an equi-join on the frame."""
    return _renamed(a, "a_").join(_renamed(b, "b_"), list(KEY)).withColumn("iou", G.iou(_box("a_"), _box("b_")))


def plate_scores(vehicles: DataFrame, plates: DataFrame, min_confidence: float = 0.25) -> DataFrame:
    """Containment score of each vehicle and plate of a frame with any; plates below the confidence are left out."""
    sure = plates.where(F.coalesce("confidence", F.lit(1.0)) >= min_confidence)
    pairs = _renamed(vehicles, "v_").join(_renamed(sure, "p_"), list(KEY))
    return pairs.withColumn("score", G.containment(_box("v_"), _box("p_"))).where("score > 0")


def best_plate(vehicles: DataFrame, plates: DataFrame, min_confidence: float = 0.25) -> DataFrame:
    """Each vehicle's best plate, whoever else takes it."""
    by = Window.partitionBy(*KEY, "v_track_id").orderBy(F.desc("score"), "p_ord")
    return plate_scores(vehicles, plates, min_confidence).withColumn("_p", F.row_number().over(by)).where("_p = 1").drop("_p")


def best_score(vehicles: DataFrame, plates: DataFrame) -> DataFrame:
    """Highest score of any plate, 0 without one, for every vehicle."""
    top = plate_scores(vehicles, plates, float("-inf")).groupBy(*KEY, F.col("v_track_id").alias("track_id")).agg(F.max("score").alias("best"))
    return vehicles.select(*KEY, "track_id").join(top, [*KEY, "track_id"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def assign_plates(vehicles: DataFrame, plates: DataFrame, min_confidence: float = 0.25) -> DataFrame:
    """Plates to vehicles one by one: vehicles by best score (ties: smaller id), each takes its best plate still free.

    An ordered fold over a frame's pairs, sorted by (vehicle's turn, score); a frame has few.
    The first plate (p_ord) wins ties. Only assigned pairs come out.
    """
    pairs = plate_scores(vehicles, plates, min_confidence)
    any_score = best_score(vehicles, plates).select(*KEY, F.col("track_id").alias("v_track_id"), "best")
    rows = pairs.join(any_score, [*KEY, "v_track_id"])
    order = F.struct((-F.col("best")).alias("a"), F.col("v_track_id").alias("v"), (-F.col("score")).alias("s"), F.col("p_ord").alias("p"))
    frames = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(order)).alias("_pairs"))
    free = lambda taken, r: ~F.exists(taken, lambda t: (t["v"] == r["v"]) | (t["p"] == r["p"]))
    chosen = F.aggregate("_pairs", F.filter("_pairs", lambda r: F.lit(False)), lambda taken, r: F.when(free(taken, r), F.concat(taken, F.array(r))).otherwise(taken))
    return frames.select(*KEY, F.explode(chosen).alias("_r")).select(*KEY, F.col("_r.v").alias("track_id"), F.col("_r.p").alias("plate_ord"), (-F.col("_r.s")).alias("score"))


def optimal(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, by shortest augmenting paths; the longer side keeps some unpaired.

    Non-finite costs count as 1e6.
    """
    cost = np.where(np.isfinite(cost), cost, 1e6).astype(float)
    if cost.size == 0:
        return []
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        least, before, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, at, low = i, -1, 0.0
        while True:
            reach = low + c[row] - u[row] - v
            better = ~seen & (reach < least)
            least[better], before[better] = reach[better], at
            at = int(np.argmin(np.where(seen, np.inf, least)))
            low = least[at]
            seen[at] = True
            if row_of[at] < 0:
                break
            row = row_of[at]
        end = at
        done = seen.copy()
        done[end] = False
        u[i] += low
        for j in np.flatnonzero(done):
            u[row_of[j]] += low - least[j]
            v[j] -= low - least[j]
        while at >= 0:
            row_of[at] = row_of[before[at]] if before[at] >= 0 else i
            at = before[at]
    pairs = [(int(row_of[j]), j) for j in range(m) if row_of[j] >= 0]
    return sorted((j, i) if flipped else (i, j) for i, j in pairs)


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:4], b[None, :, 2:4])
    inner = np.clip(high - low, 0, None).prod(2)
    size = lambda x: np.clip(x[:, 2:4] - x[:, :2], 0, None).prod(1)
    union = size(a)[:, None] + size(b)[None] - inner
    return np.where(union > 0, inner / np.where(union > 0, union, 1), 0.0)


def match(a: np.ndarray, b: np.ndarray, threshold: float = 0.3) -> list[tuple[int, int, float]]:
    """One-to-one pairs of least summed 1 - IoU, without those below the threshold."""
    overlap = iou_matrix(a, b)
    return [(i, j, float(overlap[i, j])) for i, j in optimal(1 - overlap) if overlap[i, j] >= threshold]


def match_frames(a: DataFrame, b: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Optimal pairs of a frame's boxes: (video_id, frame_index, a_ord, b_ord, iou).

    Each side's boxes become one array per frame and meet in an equi-join, so Python gets
    Arrow batches of many frames and not a call per frame.
    """

    def boxes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("ord", *[F.col(e).cast("double").alias(e) for e in EDGES]))).alias(name))

    def run(batches):
        for pdf in batches:
            out = []
            for video, frame, left, right in zip(pdf["video_id"], pdf["frame_index"], pdf["a"], pdf["b"], strict=True):
                x, y = (np.array([[r[e] for e in EDGES] for r in side]).reshape(-1, 4) for side in (left, right))
                out += [(video, frame, left[i]["ord"], right[j]["ord"], v) for i, j, v in match(x, y, threshold)]
            yield pd.DataFrame(out, columns=["video_id", "frame_index", "a_ord", "b_ord", "iou"])

    both = boxes(a, "a").join(boxes(b, "b"), list(KEY))
    return both.mapInPandas(run, "video_id long, frame_index long, a_ord long, b_ord long, iou double")
