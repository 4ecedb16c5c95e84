"""Rallies over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds


def stream_rallies(events: DataFrame, watermark: str = "120 seconds", t: Thresholds = DEFAULT) -> DataFrame:
    """match_id, start_frame, end_frame, n_events, last_track from a stream of events, a frame counted as a second.

    Sessions of one gap join events up to and including the gap, as the batch operator does. In append mode a rally
    comes out once the watermark has passed its end, so the last open one is withheld.
    """
    timed = events.withColumn("at", F.timestamp_seconds("frame_idx")).withWatermark("at", watermark)
    grouped = timed.groupBy("match_id", F.session_window("at", f"{t.rally_gap} seconds"))
    hitter = F.max_by("track_id", F.when(F.col("type") == "hit", F.col("frame_idx")))
    return grouped.agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count(F.lit(1)).alias("n_events"), hitter.alias("last_track")).drop("session_window")
