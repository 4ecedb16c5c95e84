"""Differences over visible ball rows and the detectors that read them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.geometry import to_court


def visible(ball: DataFrame) -> DataFrame:
    return ball.where(F.col("x_px").isNotNull() & F.col("y_px").isNotNull())


def differences(ball: DataFrame, homography: Sequence[Column], t: Thresholds = DEFAULT) -> DataFrame:
    """Visible rows with the steps from the row before (0) and to the row after (1), not divided by the frame gap.

    Matches with fewer visible rows than `min_visible` are kept here; see `enough_visible`. n_visible counts the rows
    around, which are as many as that if the match has as many.
    """
    around = t.min_visible - 1
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    x, y = F.col("x_px"), F.col("y_px")
    cx, cy = to_court(x, y, homography)
    return visible(ball).select(
        "match_id",
        "frame_idx",
        x.alias("x"),
        y.alias("y"),
        (x - F.lag(x).over(w)).alias("vx0"),
        (F.lead(x).over(w) - x).alias("vx1"),
        (y - F.lag(y).over(w)).alias("vy0"),
        (F.lead(y).over(w) - y).alias("vy1"),
        cx.alias("cx"),
        cy.alias("cy"),
        F.count(F.lit(1)).over(w.rowsBetween(-around, around)).alias("n_visible"),
    )


def enough_visible(steps: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """A match with fewer visible rows has no events at all."""
    return steps.where(F.col("n_visible") >= t.min_visible)


def acceleration() -> Column:
    dx, dy = F.col("vx1") - F.col("vx0"), F.col("vy1") - F.col("vy0")
    return F.sqrt(dx * dx + dy * dy)


def is_peak(t: Thresholds = DEFAULT) -> Column:
    return F.coalesce(acceleration() >= t.min_acceleration, F.lit(False))


def acceleration_peaks(steps: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    return enough_visible(steps, t).where(is_peak(t))


def _event(rows: DataFrame, kind: str, confidence: float) -> DataFrame:
    return rows.select("match_id", "frame_idx", F.lit(kind).alias("type"), "x", "y", F.lit(None).cast("int").alias("track_id"), F.lit(confidence).alias("confidence"))


def is_bounce(fps: float = 30.0, t: Thresholds = DEFAULT) -> Column:
    """Down, then up, both faster than a bound that scales with the frame rate."""
    bound = t.bounce_speed_at_30_fps * (fps / 30.0)
    return F.coalesce((F.col("vy0") > bound) & (F.col("vy1") < -bound), F.lit(False))


def bounces(steps: DataFrame, fps: float = 30.0, t: Thresholds = DEFAULT) -> DataFrame:
    return _event(enough_visible(steps, t).where(is_bounce(fps, t)), "bounce", t.bounce_confidence)


def is_wall_hit(t: Thresholds = DEFAULT) -> Column:
    """A reversal of speed near an edge of the court. The y signs are those of the image, as defined."""
    s, m = t.wall_speed, t.wall_margin_m
    turns = lambda v, up: (F.col(f"{v}0") < -s) & (F.col(f"{v}1") > s) if up else (F.col(f"{v}0") > s) & (F.col(f"{v}1") < -s)
    cx, cy = F.col("cx"), F.col("cy")
    x_turn = (cx < m) & turns("vx", True) | (cx > t.court_width_m - m) & turns("vx", False)
    y_turn = (cy < m) & turns("vy", True) | (cy > t.court_length_m - m) & turns("vy", False)
    return F.coalesce(x_turn | y_turn, F.lit(False))


def wall_hits(steps: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    return _event(enough_visible(steps, t).where(is_wall_hit(t)), "wall_hit", t.wall_confidence)


def gap_runs(ball: DataFrame) -> DataFrame:
    """match_id, first_frame, last_frame, n_rows, interior: runs of consecutive rows without a ball."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    hidden = F.col("x_px").isNull()
    rows = ball.select("match_id", "frame_idx", hidden.alias("hidden"), F.row_number().over(w).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("match_id")).alias("total"))
    seen = F.sum(F.when(~F.col("hidden"), 1).otherwise(0)).over(w)
    runs = rows.withColumn("island", seen).where("hidden").groupBy("match_id", "island")
    frames = F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame")
    out = runs.agg(*frames, F.count(F.lit(1)).alias("n_rows"), F.min("n").alias("a"), F.max("n").alias("b"), F.max("total").alias("total"))
    return out.select("match_id", "first_frame", "last_frame", "n_rows", ((F.col("a") > 1) & (F.col("b") < F.col("total"))).alias("interior"))


def inference_control(ball: DataFrame, stride: int) -> DataFrame:
    """match_id, frame_idx, infer: whether a three-frame buffer is full and the frame is on the stride."""
    w = Window.partitionBy("match_id").orderBy("frame_idx").rowsBetween(-2, 0)
    return ball.select("match_id", "frame_idx", ((F.count(F.lit(1)).over(w) == 3) & (F.col("frame_idx") % stride == 0)).alias("infer"))
