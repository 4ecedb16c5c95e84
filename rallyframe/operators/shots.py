"""Shot features and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.geometry import at_back, at_net, distance
from .joins import interval_join


def _keys() -> list[str]:
    return ["match_id", "frame_idx", "track_id"]


def ball_around(hits: DataFrame, ball: DataFrame, fps: float = 30.0, t: Thresholds = DEFAULT) -> DataFrame:
    """The columns of the hits, and median_y, speed_px and speed_ms, from one join with the ball.

    median_y: median height of the ball over the frames before a hit, null without any. Speeds: mean steps over
    visible rows from the hit on, 0 for fewer than two.
    """
    near = interval_join(hits, ball.select("match_id", "frame_idx", "x", "y", "cx", "cy"), t.before, t.after, "left")
    gap = F.col("r_frame_idx") - F.col("frame_idx")
    after = F.when(gap >= 0, F.struct("r_frame_idx", "r_x", "r_y", "r_cx", "r_cy"))
    median = F.percentile(F.when(gap < 0, F.col("r_y")), 0.5)
    each = near.groupBy(*hits.columns).agg(median.alias("median_y"), F.array_sort(F.collect_list(after)).alias("path"))
    pairs = F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("a"), F.slice("path", 2, F.size("path")).alias("b"))

    def mean(x: str, y: str) -> Column:
        steps = F.transform("pairs", lambda p: distance(p["b"][x], p["b"][y], p["a"][x], p["a"][y]))
        total = F.aggregate(F.filter(steps, lambda d: d.isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda s, d: F.struct((s["s"] + d).alias("s"), (s["n"] + 1).alias("n")))
        return F.coalesce(F.try_divide(total["s"], total["n"]), F.lit(0.0))

    each = each.withColumn("pairs", pairs)
    return each.select(*hits.columns, "median_y", mean("r_x", "r_y").alias("speed_px"), (mean("r_cx", "r_cy") * fps).alias("speed_ms"))


def arm_features(t: Thresholds = DEFAULT) -> tuple[Column, Column]:
    """(above head, high) from shoulder and wrist heights and confidences; false without a trusted wrist."""
    c = F.col
    wrist = F.when(c("lw_c") >= c("rw_c"), c("lw_y")).otherwise(c("rw_y"))
    shoulder = F.when(F.least("ls_c", "rs_c") > t.keypoint_confidence, F.least("ls_y", "rs_y")).otherwise(wrist + t.shoulder_fallback_px)
    trusted = F.greatest("lw_c", "rw_c") > t.keypoint_confidence
    test = lambda offset: F.coalesce(trusted & (wrist < shoulder + offset), F.lit(False))
    return test(t.above_offset_px), test(t.high_arm_offset_px)


def shot_features(hits: DataFrame, players: DataFrame, ball: DataFrame, poses: DataFrame | None = None, fps: float = 30.0, t: Thresholds = DEFAULT) -> DataFrame:
    """One row a hit. Position and pose are those of the hit's very frame; the first detection and no fallback.

    ball: visible rows with x, y, cx, cy. poses: match_id, frame_idx, track_id and the shoulders' and wrists' columns.
    """
    out = ball_around(hits.select(*_keys(), "x", "y"), ball, fps, t)
    here = out.join(players.select(*_keys(), "foot_y_m", "det_seq"), _keys(), "left")
    out = here.groupBy(*out.columns).agg(F.min_by("foot_y_m", "det_seq").alias("player_y"))
    above = high_arm = F.lit(False)
    if poses is not None:
        out = out.join(poses.select(*_keys(), "ls_y", "rs_y", "lw_y", "rw_y", "ls_c", "rs_c", "lw_c", "rw_c"), _keys(), "left")
        above, high_arm = arm_features(t)
    # A median of exactly 0 counts as none.
    high = F.coalesce((F.col("median_y") != 0) & (F.col("median_y") < F.col("y") - t.high_offset_px), F.lit(False))
    return out.select(
        *_keys(),
        "median_y",
        "speed_px",
        "speed_ms",
        high.alias("ball_high"),
        at_net(F.col("player_y"), t).alias("at_net"),
        at_back(F.col("player_y"), t).alias("at_back"),
        above.alias("arm_above"),
        high_arm.alias("arm_high"),
    )


def classify(features: DataFrame, calibrated: bool = True, t: Thresholds = DEFAULT) -> DataFrame:
    """match_id, frame_idx, track_id, shot_type, confidence by the first rule that holds; no hitter is other, 0."""
    c = F.col
    speed, fast, medium = ("speed_ms", t.fast_ms, t.medium_ms) if calibrated else ("speed_px", t.fast_px, t.medium_px)
    is_fast, is_medium = c(speed) > fast, c(speed) > medium
    shot = lambda kind, confidence: F.struct(F.lit(kind).alias("shot_type"), F.lit(confidence).alias("confidence"))
    rules = (
        (c("track_id").isNull(), "other", 0.0),
        (c("arm_above") & c("ball_high"), "smash", 0.82),
        (c("ball_high") & is_fast & (c("at_back") | c("at_net")), "smash", 0.62),
        (c("arm_high") & c("at_back") & c("ball_high"), "bandeja", 0.65),
        (c("ball_high") & is_medium & c("at_back"), "bandeja", 0.50),
        (c("at_net") & ~c("arm_above") & ~c("ball_high"), "volley", 0.60),
        (c("at_net") & is_medium, "volley", 0.45),
    )
    decided = F.when(rules[0][0], shot(*rules[0][1:]))
    for test, kind, confidence in rules[1:]:
        decided = decided.when(test, shot(kind, confidence))
    return features.select(*_keys(), decided.otherwise(shot("other", 0.40)).alias("s")).select(*_keys(), "s.*")
