"""Streaming forms: watermarks, windows, repeated frames, and kept crops per track."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import BestFrameRules
from ..operators.topk import KEPT, add_crop, in_place


def timed(events: DataFrame, late: str = "10 minutes", column: str = "ts") -> DataFrame:
    """Event time as a timestamp (types without a zone cannot carry a watermark) with a watermark."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def windowed(events: DataFrame, length: str, slide: str | None = None, by: str = "event_type") -> DataFrame:
    """Tumbling or sliding counts and sums of ``value``."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w, by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def track_sessions(events: DataFrame, gap: str, by: str = "user_id") -> DataFrame:
    """A track lives until it is unseen for ``gap``: one row per session."""
    return events.groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("hits"), F.max("value").alias("best"))


def without_repeats(events: DataFrame, *keys: str) -> DataFrame:
    """Frames sent again within the watermark are dropped."""
    return events.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def best_crops_stream(candidates: DataFrame, rules: BestFrameRules = BestFrameRules(), interval: int = 5) -> DataFrame:
    """Kept crops of every track after each batch (update mode): the state is at most k rows a track."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    k, gap = max(1, rules.k), rules.gap(interval)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in zip(*state.get, strict=True)] if state.exists else []
        rows = pd.concat(list(parts)).sort_values("ord", kind="stable")
        for r in rows.itertuples():
            kept = add_crop(kept, (int(r.frame_index), r.source != "fallback", float(r.score), int(r.ord)), k, gap)
        state.update(tuple(list(c) for c in zip(*kept, strict=True)) if kept else ([], [], [], []))
        yield pd.DataFrame(in_place(key[0], kept), columns=[c.split()[0] for c in KEPT.split(", ")])

    state = "frame_index array<long>, is_detection array<boolean>, score array<double>, ord array<long>"
    return candidates.groupBy("track_id").applyInPandasWithState(run, KEPT, state, "update", GroupStateTimeout.NoTimeout)


def collected(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return its output as a table in memory (for small results)."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
