"""As-of, nearest-neighbour and interval joins.

All of them keep match_id as an equality. Where one match alone is too large for that, frames are cut into buckets: the
event side goes to every bucket its interval meets, each row of the other side lies in one, so nothing is found twice
and the range is a residual condition inside a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.geometry import distance
from . import kinematics

BUCKET = 64


def interval_join(left: DataFrame, right: DataFrame, before: int, after: int, how: str = "inner", frame: str = "frame_idx", bucket: int = BUCKET, only: Column | None = None) -> DataFrame:
    """Rows of `right` with frame_idx in [left.frame - before, left.frame + after]; its columns get the prefix r_.

    With `how` left, a row of `left` without any, and one for which `only` doesn't hold, comes with nulls once; one
    whose interval meets two buckets may also come with nulls beside its rows.
    """
    right = right.select(F.col("match_id").alias("r_match_id"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != "match_id"])
    right = right.withColumn("r_bucket", F.floor(F.col("r_frame_idx") / bucket))
    first, last = F.floor((F.col(frame) - before) / bucket), F.floor((F.col(frame) + after) / bucket)
    buckets = F.sequence(first, last)
    if only is not None:
        buckets = F.when(only, buckets).otherwise(F.array(F.lit(None).cast("long")))
    spread = left.withColumn("l_bucket", F.explode(buckets))
    near = (F.col("match_id") == F.col("r_match_id")) & (F.col("l_bucket") == F.col("r_bucket"))
    return spread.join(right, near & F.col("r_frame_idx").between(F.col(frame) - before, F.col(frame) + after), how).drop("r_match_id", "r_bucket", "l_bucket")


def nearest_player(events: DataFrame, players: DataFrame, dist: Column, t: Thresholds = DEFAULT, only: Column | None = None) -> DataFrame:
    """Each event with r_track_id and dist of the nearest player of the nearest frame that has any.

    Exact frame first, then +1, -1, +2 ... within the radius; the frame is chosen before the player, and the first
    detection wins a tie. `dist` may use the event's columns and the player's with the prefix r_. With `only`, all
    events stay, and those for which it doesn't hold, or that have no player near, have nulls.
    """
    if only is None:
        # The event's own frame comes first: only events of frames without players look around.
        right = players.select(*[F.col(c).alias(f"r_{c}") for c in players.columns])
        here = events.join(right, (F.col("match_id") == F.col("r_match_id")) & (F.col("frame_idx") == F.col("r_frame_idx"))).withColumn("dist", dist)
        best = here.groupBy(*events.columns).agg(F.min_by(F.struct("r_track_id", "dist"), F.struct("dist", "r_det_seq")).alias("b"))
        empty = events.join(players.select("match_id", "frame_idx").distinct(), ["match_id", "frame_idx"], "left_anti").select(*events.columns)
        around = _nearest_around(empty, players, dist, t, None)
        return best.select(*events.columns, "b.r_track_id", "b.dist").unionByName(around)
    return _nearest_around(events, players, dist, t, only)


def _nearest_around(events: DataFrame, players: DataFrame, dist: Column, t: Thresholds, only: Column | None) -> DataFrame:
    how = "inner" if only is None else "left"
    near = interval_join(events, players, t.nearest_radius, t.nearest_radius, how, only=only).withColumn("dist", dist)
    gap = F.col("r_frame_idx") - F.col("frame_idx")
    order = F.struct(F.abs(gap).alias("gap"), F.when(gap < 0, 1).otherwise(0).alias("back"), "dist", "r_det_seq")
    least = F.min_by(F.struct("r_track_id", "dist"), F.when(F.col("r_frame_idx").isNotNull(), order)).alias("b")
    return near.groupBy(*events.columns).agg(least).select(*events.columns, "b.r_track_id", "b.dist")


def _near_enough(calibrated: bool, t: Thresholds) -> tuple[Column, float]:
    """Distance of a player to the ball, in metres with a calibration and in pixels without, and its bound."""
    if calibrated:
        return distance(F.col("r_foot_x_m"), F.col("r_foot_y_m"), F.col("cx"), F.col("cy")), t.hit_m
    return distance(F.col("r_foot_x_px"), F.col("r_foot_y_px"), F.col("x"), F.col("y")), t.hit_px


def detected_events(steps: DataFrame, players: DataFrame, fps: float = 30.0, calibrated: bool = True, t: Thresholds = DEFAULT) -> DataFrame:
    """Hits, bounces and wall hits, not yet deduplicated, from one pass over the steps."""
    flags = kinematics.enough_visible(steps, t).select(
        "match_id", "frame_idx", "x", "y", "cx", "cy", kinematics.is_peak(t).alias("peak"), kinematics.is_bounce(fps, t).alias("bounce"), kinematics.is_wall_hit(t).alias("wall")
    )
    dist, bound = _near_enough(calibrated, t)
    found = nearest_player(flags.where("peak or bounce or wall"), players, dist, t, F.col("peak"))
    kind = lambda test, name, track, confidence: F.when(test, F.struct(F.lit(name).alias("type"), track.alias("track_id"), F.lit(confidence).alias("confidence")))
    nobody = F.lit(None).cast(players.schema["track_id"].dataType)
    kinds = F.array(
        kind(F.col("dist") < bound, "hit", F.col("r_track_id"), t.hit_confidence),
        kind(F.col("bounce"), "bounce", nobody, t.bounce_confidence),
        kind(F.col("wall"), "wall_hit", nobody, t.wall_confidence),
    )
    each = found.select("match_id", "frame_idx", "x", "y", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return each.select("match_id", "frame_idx", "k.type", "x", "y", "k.track_id", "k.confidence")


def hits(peaks: DataFrame, players: DataFrame, calibrated: bool = True, t: Thresholds = DEFAULT) -> DataFrame:
    """Acceleration peaks with a player near enough; metres with a calibration, pixels without."""
    dist, bound = _near_enough(calibrated, t)
    rows = peaks.select("match_id", "frame_idx", "x", "y", "cx", "cy")
    found = nearest_player(rows, players, dist, t).where(F.col("dist") < bound)
    return found.select("match_id", "frame_idx", F.lit("hit").alias("type"), "x", "y", F.col("r_track_id").alias("track_id"), F.lit(t.hit_confidence).alias("confidence"))


def match_poses(poses: DataFrame, players: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Each pose to the nearest foot; a later pose of a frame overwrites an earlier one of the same track."""
    dist = distance(F.col("r_foot_x_px"), F.col("r_foot_y_px"), F.col("pose_foot_x_px"), F.col("pose_foot_y_px"))
    keys = poses.select("match_id", "frame_idx", "pose_seq", "pose_foot_x_px", "pose_foot_y_px")
    near = nearest_player(keys, players, dist, t).where(F.col("dist") < t.pose_foot_px)
    return near.groupBy("match_id", "frame_idx", F.col("r_track_id").alias("track_id")).agg(F.max("pose_seq").alias("pose_seq"))


def pose_targets(ball: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """match_id, frame_idx: the first visible frames of each match and their neighbourhood, each once."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    first = ball.where(F.col("x_px").isNotNull()).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= t.pose_frames)
    spread = F.explode(F.sequence(F.col("frame_idx") - t.pose_window, F.col("frame_idx") + t.pose_window))
    return first.select("match_id", spread.alias("frame_idx")).distinct()
