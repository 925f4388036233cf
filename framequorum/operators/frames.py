"""Frame selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import FrameRules


def sampled(frames: DataFrame, rules: FrameRules, fps: float, index: str = "frame_index") -> DataFrame:
    """Every ``interval``-th frame after the skipped head, and before the duration ends."""
    skip = rules.skip_frames + round(rules.start_seconds * fps)
    i = F.col(index)
    out = frames.where((i >= skip) & ((i - skip) % max(1, rules.interval) == 0))
    return out if rules.max_duration is None else out.where(i / F.lit(float(fps)) < rules.max_duration)


def quality(brightness: Column, blur: Column, rules: FrameRules) -> Column:
    """``dark`` before ``blurry``; else ``kept``."""
    return F.when(brightness < rules.min_brightness, "dark").when(blur < rules.min_blur_score, "blurry").otherwise("kept")


def with_quality(frames: DataFrame, rules: FrameRules) -> DataFrame:
    return frames.withColumn("quality", quality(F.col("brightness"), F.col("blur_score"), rules))


def kept(frames: DataFrame, rules: FrameRules, fps: float) -> DataFrame:
    """Sampled frames of good quality, the first ``max_frames`` of each video if that is set."""
    out = with_quality(sampled(frames, rules, fps), rules).where("quality = 'kept'").drop("quality")
    if not rules.max_frames:
        return out
    by = Window.partitionBy("video_id").orderBy("frame_index")
    return out.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= rules.max_frames).drop("_n")


def extraction_stats(frames: DataFrame, rules: FrameRules, fps: float) -> DataFrame:
    """Per video: frames scanned, sampled, dark, blurry and kept."""
    skip = rules.skip_frames + round(rules.start_seconds * fps)
    i = F.col("frame_index")
    on = (i >= skip) & ((i - skip) % max(1, rules.interval) == 0)
    rows = with_quality(frames, rules).withColumn("_on", on)
    count = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy("video_id").agg(F.count("*").alias("scanned"), count(F.col("_on"), "sampled"), count(F.col("_on") & (F.col("quality") == "dark"), "dark"), count(F.col("_on") & (F.col("quality") == "blurry"), "blurry"), count(F.col("_on") & (F.col("quality") == "kept"), "kept"))
