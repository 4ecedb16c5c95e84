"""Events together: union, greedy deduplication, order, rallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds


def all_events(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dedup_events(events: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Keep an event if it is `dedup_gap` frames or more after the last one kept of its type and match.

    An event so many frames after the one before it, kept or not, is always kept, so it begins an island of its own.
    Inside an island the scan depends on what it kept: a fold over its few rows, whose state is what it kept so far.
    """
    fields = ("frame_idx", "x", "y", "track_id", "confidence")
    w = Window.partitionBy("match_id", "type").orderBy(*fields)
    gap = F.col("frame_idx") - F.lag("frame_idx").over(w)
    begun = events.withColumn("begins", F.when(gap >= t.dedup_gap, 1).otherwise(0))
    islands = begun.withColumn("island", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct(*fields)
    grouped = islands.groupBy("match_id", "type", "island").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.slice("rows", 1, 0)
    new = lambda kept, x: x["frame_idx"] - F.element_at(kept, -1)["frame_idx"] >= t.dedup_gap
    kept = F.aggregate("rows", none, lambda kept, x: F.when((F.size(kept) == 0) | new(kept, x), F.array_append(kept, x)).otherwise(kept))
    each = grouped.select("match_id", "type", F.explode(kept).alias("r"))
    return each.select("match_id", F.col("r.frame_idx").alias("frame_idx"), "type", "r.x", "r.y", "r.track_id", "r.confidence")


def ordered(events: DataFrame) -> DataFrame:
    """By match and frame; hit before bounce before wall_hit within one."""
    rank = F.when(F.col("type") == "hit", 0).when(F.col("type") == "bounce", 1).otherwise(2)
    return events.orderBy("match_id", "frame_idx", rank)


def rallies(events: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """match_id, rally_idx, start_frame, end_frame, last_track: a pause of more than `rally_gap` frames starts anew.

    The last hitter is that of the rally's last hit; bounces leave it.
    """
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    new = F.when(F.col("frame_idx") - F.lag("frame_idx").over(w) > t.rally_gap, 1).otherwise(0)
    marked = events.select("match_id", "frame_idx", "type", "track_id", new.alias("new"))
    up_to = w.rangeBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("rally_idx", F.sum("new").over(up_to))
    hitter = F.max_by("track_id", F.when(F.col("type") == "hit", F.col("frame_idx")))
    return numbered.groupBy("match_id", "rally_idx").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), hitter.alias("last_track"))
