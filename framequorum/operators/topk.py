"""Best crops per track: greedy, gap-constrained, in order of arrival."""

from __future__ import annotations

from bisect import insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..config import BestFrameRules
from ..functions.scoring import crop_score, expected_aspect


KEPT = "track_id long, place int, frame_index long, ord long, score double, is_detection boolean"


def add_crop(kept: list[tuple], new: tuple, k: int, gap: int) -> list[tuple]:
    """One step of the greedy buffer; rows are (frame_index, is_detection, score, ord).

    A detection drops all fallbacks; a fallback is refused once a detection is kept; rows
    closer than ``gap`` frames conflict, and a newcomer must beat all of them to take their
    place; a full buffer gives up its worst row (of equal ones the one kept longest) to a
    better one, else refuses. A row without a score is worse than any other; one without a
    frame conflicts with none.
    """
    key = lambda r: (r[1], r[2] is not None, r[2] or 0.0)
    real = [r for r in kept if r[1]] if new[1] else kept
    if not new[1] and any(r[1] for r in kept):
        return kept
    near = [r for r in real if r[0] is not None and new[0] is not None and abs(r[0] - new[0]) < gap]
    if any(key(r) >= key(new) for r in near):
        return real
    free = [r for r in real if r not in near]
    if len(free) < k:
        return [*free, new]
    worst = min(free, key=key)
    return [*(r for r in free if r is not worst), new] if key(new) > key(worst) else free


def in_place(track: int, kept: list[tuple]) -> list[tuple]:
    """Rows of KEPT: detections first, then by score; equal rows as they were kept."""
    order = sorted(range(len(kept)), key=lambda i: (not kept[i][1], kept[i][2] is None, -(kept[i][2] or 0.0), i))
    return [(track, place + 1, kept[i][0], kept[i][3], kept[i][2], kept[i][1]) for place, i in enumerate(order)]


def best_crops(candidates: DataFrame, rules: BestFrameRules = BestFrameRules(), interval: int = 5) -> DataFrame:
    """Kept crops of every track with their ``place``: detections first, then by score.

    candidates: track_id, frame_index, score, source, ord (unique per track, arrival order).
    Equal rows keep their arrival order. Tracks are sorted, with spill, and go through in
    Arrow batches: a task holds the kept rows of one track, however long it is.
    """
    k, gap = max(1, rules.k), rules.gap(interval)
    schema = pa.schema([("track_id", pa.int64()), ("place", pa.int32()), ("frame_index", pa.int64()), ("ord", pa.int64()), ("score", pa.float64()), ("is_detection", pa.bool_())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        track, kept = None, []
        for batch in batches:
            done = []
            for t, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != track:
                    done += in_place(track, kept)
                    track, kept = t, []
                kept = add_crop(kept, tuple(row), k, gap)
            if done:
                yield table(done)
        if kept:
            yield table(in_place(track, kept))

    real = F.coalesce(F.col("source") != "fallback", F.lit(False))
    rows = candidates.select(F.col("track_id").cast("long").alias("track_id"), F.col("frame_index").cast("long").alias("frame_index"), real.alias("is_detection"), F.col("score").cast("double").alias("score"), F.col("ord").cast("long").alias("ord"))
    return rows.repartition("track_id").sortWithinPartitions("track_id", "frame_index", "ord").mapInArrow(run, KEPT)


def latched(candidates: DataFrame) -> DataFrame:
    """Without fallbacks that come after the track's first detection."""
    so_far = Window.partitionBy("track_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.max((F.col("source") != "fallback").cast("int")).over(so_far)
    return candidates.withColumn("_seen", seen).where((F.col("source") != "fallback") | (F.col("_seen") == 0)).drop("_seen")


def running_median(rows: DataFrame, value: str, key: str, order: str, out: str = "_median") -> DataFrame:
    """Add the median of a key's values up to each row, nulls left out: one pass over sorted rows.

    Only the values of the key at hand are held, in order; rows go through in Arrow batches.
    """

    def run(batches):
        current, held = None, []
        for batch in batches:
            keys, values = batch.column(batch.schema.get_field_index(key)).to_pylist(), batch.column(batch.schema.get_field_index(value)).to_pylist()
            medians = []
            for k, v in zip(keys, values, strict=True):
                if k != current:
                    current, held = k, []
                if v is not None:
                    insort(held, v)
                n = len(held)
                medians.append(None if not n else held[n // 2] if n % 2 else 0.5 * held[n // 2 - 1] + 0.5 * held[n // 2])
            yield batch.append_column(out, pa.array(medians, pa.float64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{fields}, {out} double")


def running_aspect(candidates: DataFrame, rules: BestFrameRules = BestFrameRules()) -> DataFrame:
    """Add the expected aspect of every row: from the median aspect of the track's detections up to it."""
    aspect = F.when((F.col("source") != "fallback") & (F.col("h") > 0), F.col("w") / F.col("h").cast("double"))
    out = running_median(candidates.withColumn("_aspect", aspect), "_aspect", "track_id", "ord")
    return out.withColumn("expected", expected_aspect(F.col("_median"), rules)).drop("_aspect", "_median")


def scored(candidates: DataFrame, rules: BestFrameRules = BestFrameRules()) -> DataFrame:
    """Rows tall enough, with the struct ``detail`` of their score."""
    tall = running_aspect(candidates, rules).where(F.col("h") >= rules.min_plate_height)
    return tall.withColumn("detail", crop_score(F.col("variance"), F.col("w"), F.col("h"), F.col("confidence"), F.col("exposure"), F.col("expected"), rules))


def flushed(candidates: DataFrame, rules: BestFrameRules = BestFrameRules(), interval: int = 5) -> DataFrame:
    """Collect then flush: latch, score, keep the best crops of each track."""
    rows = scored(latched(candidates), rules)
    return best_crops(rows.select("track_id", "frame_index", "ord", "source", F.col("detail.total").alias("score")), rules, interval)
