"""Every constant of the analytics, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the domain; lengths in metres or pixels, gaps in frames, as the names say."""

    court_width_m: float = 10.0
    court_length_m: float = 20.0
    calibration_samples: int = 30
    calibration_seconds: int = 5
    court_margin_px: float = 50.0
    nearest_radius: int = 6
    max_gap: int = 6
    kalman_r: float = 25.0
    kalman_q: float = 0.8
    kalman_p0: float = 100.0
    fill_confidence: float = 0.3
    quadratic_context: int = 5
    hit_px: float = 100.0
    hit_m: float = 2.5
    min_acceleration: float = 25.0
    min_visible: int = 5
    wall_margin_m: float = 0.8
    wall_speed: float = 3.0
    bounce_speed_at_30_fps: float = 4.0
    hit_confidence: float = 0.8
    bounce_confidence: float = 0.6
    wall_confidence: float = 0.65
    dedup_gap: int = 8
    before: int = 12
    after: int = 6
    high_offset_px: float = 30.0
    net_low_m: float = 7.0
    net_high_m: float = 13.0
    back_m: float = 4.5
    keypoint_confidence: float = 0.35
    above_offset_px: float = -25.0
    high_arm_offset_px: float = 15.0
    shoulder_fallback_px: float = 50.0
    pose_window: int = 4
    pose_foot_px: float = 120.0
    pose_frames: int = 500
    teleport_m: float = 5.0
    heat_floor: float = 0.001
    rally_gap: int = 60
    rally_tail: int = 20
    rally_ahead: int = 10
    boundary_margin_m: float = 0.6
    players: int = 4
    crop_pad: int = 24
    fast_ms: float = 18.0
    medium_ms: float = 6.0
    fast_px: float = 20.0
    medium_px: float = 8.0
    heatmap_peak: float = 0.5
    heatmap_floor: float = 0.3
    candidate_area: tuple[float, float] = (6.0, 420.0)
    candidate_circularity: float = 0.30
    candidate_score: float = 0.42
    candidate_cap: float = 0.85


DEFAULT = Thresholds()
SHOT_TYPES = ("smash", "volley", "bandeja", "other")
EVENT_TYPES = ("hit", "bounce", "wall_hit")
