"""Canonical players, distances, heat maps, crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.geometry import crop_box, distance, grid_cell


#: Rows with a place on the court; a match without a homography has none.
_PLACED = "foot_x_m is not null and foot_y_m is not null"


def player_map(players: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """match_id, track_id, player_id (0 to 3), detections: the tracks seen most; the first seen wins a tie."""
    counts = players.groupBy("match_id", "track_id").agg(F.count(F.lit(1)).alias("detections"), F.min(F.struct("frame_idx", "det_seq")).alias("first"))
    w = Window.partitionBy("match_id").orderBy(F.desc("detections"), "first")
    return counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= t.players).select("match_id", "track_id", (F.col("rn") - 1).alias("player_id"), "detections")


def mapped(players: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of canonical players with their player_id. The mapping has four rows a match, so Spark decides its side."""
    return players.join(mapping.select("match_id", "track_id", "player_id"), ["match_id", "track_id"])


def player_slots(matches: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """match_id, player_id: all four players of every match, seen or not."""
    return matches.select("match_id").distinct().select("match_id", F.explode(F.sequence(F.lit(0), F.lit(t.players - 1))).alias("player_id"))


#: Frames of a stretch, within which a player's rows are one unit of work.
STRETCH = 4096


def with_steps(tracked: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The rows with step, the metres from the player's row before, null for the first.

    Rows are cut into stretches of frames, so that a match of any length is many tasks; a stretch's first step comes from
    the last place of the player's stretch before, of which there is one row a stretch.
    """
    key = ["match_id", "player_id", "stretch"]
    rows = tracked.withColumn("stretch", F.floor(F.col("frame_idx") / stretch))
    w = Window.partitionBy(*key).orderBy("frame_idx", "det_seq")
    place = F.struct(F.col("foot_x_m").alias("x"), F.col("foot_y_m").alias("y"))
    ends = rows.groupBy(*key).agg(F.max_by(place, F.struct("frame_idx", "det_seq")).alias("last"))
    came = ends.select(*key, F.lag("last").over(Window.partitionBy("match_id", "player_id").orderBy("stretch")).alias("came"))
    walked = rows.withColumns({"before": F.lag(place).over(w), "nth": F.row_number().over(w)}).join(came, key)
    begin = F.when(F.col("nth") == 1, F.col("came")).otherwise(F.col("before"))
    step = distance(F.col("foot_x_m"), F.col("foot_y_m"), begin["x"], begin["y"])
    return walked.withColumn("step", step).select(*tracked.columns, "step")


def distances(tracked: DataFrame, t: Thresholds = DEFAULT, stretch: int = STRETCH) -> DataFrame:
    """match_id, player_id, distance_m: steps of `teleport_m` and more don't count, but the next starts from there."""
    steps = with_steps(tracked.select("match_id", "player_id", "frame_idx", "det_seq", "foot_x_m", "foot_y_m"), stretch)
    return steps.groupBy("match_id", "player_id").agg(F.round(F.coalesce(F.sum(F.when(F.col("step") < t.teleport_m, F.col("step"))), F.lit(0.0)), 2).alias("distance_m"))


def heatmap(tracked: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """match_id, player_id, x, y, weight: shares of 1 m cells above the floor, at cell centres, not normalised again."""
    cells = tracked.where(_PLACED).select("match_id", "player_id", grid_cell(F.col("foot_x_m"), 9.99).alias("ix"), grid_cell(F.col("foot_y_m"), 19.99).alias("iy"))
    counts = cells.groupBy("match_id", "player_id", "ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("match_id", "player_id"))
    return counts.withColumn("weight", share).where(F.col("weight") > t.heat_floor).select("match_id", "player_id", (F.col("ix") + 0.5).alias("x"), (F.col("iy") + 0.5).alias("y"), "weight")


def path_sums(tracked: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """match_id, player_id, distance_m, points: the results of `distances` and `heatmap` from one pass over the rows.

    points: x, y and weight of each cell, in order; there are no more cells than the court has square metres.
    """
    placed = tracked.where(_PLACED).select("match_id", "player_id", "frame_idx", "det_seq", "foot_x_m", "foot_y_m")
    rows = with_steps(placed).select("match_id", "player_id", grid_cell(F.col("foot_x_m"), 9.99).alias("ix"), grid_cell(F.col("foot_y_m"), 19.99).alias("iy"), "step")
    cells = rows.groupBy("match_id", "player_id", "ix", "iy").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("step") < t.teleport_m, F.col("step"))).alias("moved"))
    sums = cells.groupBy("match_id", "player_id").agg(
        F.round(F.coalesce(F.sum("moved"), F.lit(0.0)), 2).alias("distance_m"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("ix", "iy", "n"))).alias("cells")
    )
    weighed = F.transform("cells", lambda c: F.array(c["ix"] + 0.5, c["iy"] + 0.5, c["n"] / F.col("total")))
    return sums.select("match_id", "player_id", "distance_m", F.filter(weighed, lambda p: p[2] > t.heat_floor).alias("points"))


def best_crops(tracked: DataFrame, n_chunks: DataFrame) -> DataFrame:
    """match_id, player_id, frame_idx, score and box of the best detection; the middle third of chunks counts double."""
    rows = tracked.join(n_chunks, "match_id")
    middle = (F.col("chunk_idx") >= F.floor(F.col("n_chunks") / 3)) & (F.col("chunk_idx") < F.floor(F.col("n_chunks") * 2 / 3))
    score = F.col("confidence") * F.when(middle, 2.0).otherwise(1.0)
    best = F.max_by(F.struct("frame_idx", score.alias("score"), "x1", "y1", "x2", "y2"), F.struct(score, -F.col("chunk_idx"), -F.col("det_seq")))
    return rows.groupBy("match_id", "player_id").agg(best.alias("b")).select("match_id", "player_id", "b.*")


def crop_boxes(crops: DataFrame, width: int, height: int, t: Thresholds = DEFAULT) -> DataFrame:
    """Padded and clamped boxes; empty ones go."""
    box = crop_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(width), F.lit(height), t.crop_pad)
    out = crops.select("match_id", "player_id", "frame_idx", *[b.alias(n) for b, n in zip(box, ("left", "top", "right", "bottom"), strict=True)])
    return out.where("right > left and bottom > top")
