"""Crop scores from measured components."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import BestFrameRules


def unit(c: Column) -> Column:
    """Held in [0, 1]; NaN counts as 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(c.cast("double"), F.lit(0.0))))


def crop_score(variance: Column, width: Column, height: Column, confidence: Column, exposure: Column, expected: Column, rules: BestFrameRules = BestFrameRules()) -> Column:
    """Struct of total, sharpness, height, aspect, confidence and exposure, each in [0, 1]."""
    sharp = unit(F.log1p(variance.cast("double")) / F.log1p(F.lit(rules.sharpness_ref)))
    tall = unit(F.greatest(height.cast("double"), F.lit(0.0)) / F.lit(rules.height_ref))
    off = F.abs(F.log(width / height.cast("double")) - F.log(expected.cast("double")))
    aspect = F.when((height > 0) & (width > 0) & (expected > 0), unit(1 - off / F.lit(max(rules.aspect_tolerance, 1e-6)))).otherwise(0.0)
    sure, glare = unit(confidence), unit(exposure)
    total = rules.sharp_weight * sharp + rules.height_weight * tall + rules.aspect_weight * aspect + rules.confidence_weight * sure - rules.exposure_weight * glare
    return F.struct(unit(total).alias("total"), sharp.alias("sharpness"), tall.alias("height"), aspect.alias("aspect"), sure.alias("confidence"), glare.alias("exposure"))


def expected_aspect(median: Column, rules: BestFrameRules = BestFrameRules()) -> Column:
    """One-line or two-line plate, by the median aspect so far (null: none yet)."""
    return F.when(median.isNull(), rules.one_line_aspect).when(median < rules.two_line_below, rules.two_line_aspect).otherwise(rules.one_line_aspect)


def weighted_confidence(confidence: Column, text: Column) -> Column:
    """Aggregate: mean confidence weighted by text length, at least 1 each; 0 without rows."""
    w = F.greatest(F.lit(1), F.length(F.trim(F.coalesce(text, F.lit("")))))
    return F.coalesce(F.sum(confidence * w) / F.sum(w), F.lit(0.0))
