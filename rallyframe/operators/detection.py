"""The table logic of perception: sampling, heat maps, candidates, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.geometry import estimated_corners, homography_of_corners, ordered_corners


def sample_frames(videos: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """match_id, sample, frame_idx: evenly spaced frames of the first seconds, as whole numbers; repeats stay.

    videos: match_id, fps, n_frames.
    """
    end = F.least(F.col("n_frames"), F.floor(F.col("fps") * t.calibration_seconds))
    end = F.when(end < 1, F.least(F.col("n_frames"), F.lit(t.calibration_samples))).otherwise(end)
    n = t.calibration_samples
    last = F.greatest(end - 1, F.lit(0))
    samples = videos.select("match_id", last.alias("last"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))
    return samples.select("match_id", "sample", F.floor(F.col("sample") * F.col("last") / (n - 1)).cast("long").alias("frame_idx"))


def heatmap_positions(cells: DataFrame, scale_x: float, scale_y: float, t: Thresholds = DEFAULT) -> DataFrame:
    """frame, x, y, confidence from cells (frame, col, row, w): weighted centroid of high cells where the peak is high."""
    high = F.col("w") > t.heatmap_floor
    centre = lambda axis: F.sum(F.when(high, F.col(axis) * F.col("w"))) / F.sum(F.when(high, F.col("w")))
    out = cells.groupBy("frame").agg(F.max("w").alias("confidence"), centre("col").alias("cx"), centre("row").alias("cy"))
    seen = F.col("confidence") >= t.heatmap_peak
    return out.select("frame", F.when(seen, F.col("cx") * scale_x).alias("x"), F.when(seen, F.col("cy") * scale_y).alias("y"), "confidence")


def best_candidates(frames: DataFrame, candidates: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """match_id, frame_idx, x, y, confidence: the best ball candidate of each frame, null where none is good enough.

    candidates: match_id, frame_idx, seq, area, perimeter, brightness, x, y.
    """
    circ = 4 * F.pi() * F.col("area") / (F.col("perimeter") * F.col("perimeter"))
    low, high = t.candidate_area
    fit = candidates.where((F.col("area") >= low) & (F.col("area") <= high) & (F.col("perimeter") >= 1)).withColumn("circ", circ)
    scored = fit.where(F.col("circ") >= t.candidate_circularity).withColumn("score", F.col("circ") * 0.65 + F.col("brightness") * 0.35)
    best = scored.groupBy("match_id", "frame_idx").agg(F.max_by(F.struct("x", "y", "score"), F.struct("score", -F.col("seq"))).alias("b")).where(F.col("b.score") > t.candidate_score)
    confidence = F.coalesce(F.when(F.col("b").isNotNull(), F.least(F.col("b.score"), F.lit(t.candidate_cap))), F.lit(0.0))
    found = frames.join(best, ["match_id", "frame_idx"], "left")
    return found.select("match_id", "frame_idx", F.col("b.x").alias("x"), F.col("b.y").alias("y"), confidence.alias("confidence"))


def calibrations(detections: DataFrame, videos: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """match_id, homography, estimated: one row a video, from the corners detected in its sampled frames.

    detections: match_id, sample, idx, x, y, estimated, four rows a sample in any order; videos: match_id, width,
    height. Corners are ordered in each sample, their medians over reliable samples give the homography, and a match
    without any, or whose corners lie on a line, takes the corners that its frame's size suggests.
    """
    points = ordered_corners(detections.where(~F.col("estimated")), ["match_id", "sample"])
    medians = points.groupBy("match_id", "corner").agg(F.percentile("x", 0.5).alias("x"), F.percentile("y", 0.5).alias("y"))
    at = lambda name: F.max(F.when(F.col("corner") == name, F.struct("x", "y")))
    found = medians.groupBy("match_id").agg(homography_of_corners(*[at(c) for c in ("tl", "tr", "br", "bl")], t).alias("found"))
    guess = homography_of_corners(*[F.struct(x.alias("x"), y.alias("y")) for x, y in estimated_corners(F.col("width"), F.col("height"))], t)
    both = videos.select("match_id", guess.alias("guess")).join(found, "match_id", "left")
    return both.select("match_id", F.coalesce("found", "guess").alias("homography"), F.col("found").isNull().alias("estimated"))


def first_success(*strategies: Column) -> Column:
    """The first strategy that found something."""
    return F.coalesce(*strategies)


def median_corners(detections: DataFrame) -> DataFrame:
    """match_id, corner, x, y: component-wise median over reliable detections (match_id, corner, x, y, estimated)."""
    return detections.where(~F.col("estimated")).groupBy("match_id", "corner").agg(F.percentile("x", 0.5).alias("x"), F.percentile("y", 0.5).alias("y"))
