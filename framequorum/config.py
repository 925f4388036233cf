"""Thresholds of every operator, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FrameRules:
    """Which frames of a video are kept."""

    interval: int = 5
    skip_frames: int = 0
    start_seconds: float = 0.0
    max_duration: float | None = None
    max_frames: int | None = None
    min_brightness: float = 50.0
    min_blur_score: float = 100.0
    fallback_fps: float = 25.0


@dataclass(frozen=True)
class TrackRules:
    """SORT tracking."""

    iou_threshold: float = 0.3
    min_hits: int = 3
    max_age: int = 30
    classes: tuple[int, ...] = (2, 3, 5, 7)


@dataclass(frozen=True)
class BestFrameRules:
    """Crop scores and the top-k buffer of a track."""

    k: int = 5
    min_frame_gap: int | None = None
    min_plate_height: float = 24.0
    sharpness_ref: float = 1000.0
    height_ref: float = 60.0
    aspect_tolerance: float = 1.0
    one_line_aspect: float = 4.3
    two_line_aspect: float = 1.35
    two_line_below: float = 2.5
    sharp_weight: float = 0.40
    height_weight: float = 0.25
    aspect_weight: float = 0.10
    confidence_weight: float = 0.25
    exposure_weight: float = 0.10

    def gap(self, interval: int) -> int:
        """Least distance of kept frames, in original frame numbers."""
        return max(0, self.min_frame_gap) if self.min_frame_gap is not None else max(2, 2 * max(1, interval))


@dataclass(frozen=True)
class VoteRules:
    """Whole-string voting."""

    min_confidence: float = 0.35
    min_readings: int = 2
    require_valid: bool = True


@dataclass(frozen=True)
class FusionRules:
    """Position-wise fusion."""

    min_confidence: float = 0.35
    max_distance: int = 2
    second_share: float = 0.3
    confidence_exponent: float = 1.0
    quality_exponent: float = 1.0
    provinces: tuple[str, ...] = ()


@dataclass(frozen=True)
class PlateRules:
    """Plate regions within vehicles."""

    min_confidence: float = 0.25
    region_ratio: float = 0.5
    margin: float = 0.0


@dataclass(frozen=True)
class Config:
    frames: FrameRules = field(default_factory=FrameRules)
    tracks: TrackRules = field(default_factory=TrackRules)
    best: BestFrameRules = field(default_factory=BestFrameRules)
    vote: VoteRules = field(default_factory=VoteRules)
    fusion: FusionRules = field(default_factory=FusionRules)
    plates: PlateRules = field(default_factory=PlateRules)
