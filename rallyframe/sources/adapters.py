"""Deterministic tracks from the generated event and order tables, for tests and benchmarks.

They exercise the operators and are no real matches.
"""

from __future__ import annotations

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import literal_homography, to_court
from ..operators.ordered import numbered
from .containers import mux

#: The homography of the estimated corners of a 1280 x 720 frame.
HOMOGRAPHY = ((1.49576825363e-2, 5.13622264648e-3, -4.57291682326e0), (0.0, -3.597861327e-2, 2.40696922776e1), (0.0, 1.0272445293e-3, 1.0))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def homography():
    return literal_homography(HOMOGRAPHY)


def ball_raw(events: DataFrame) -> DataFrame:
    """Four matches; error rows hide the ball, and 90 frames are skipped every 400 rows."""
    match = F.expr("user_id % 4")
    hour = F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")
    rows = events.select(match.alias("match_id"), "ts", "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    rows = numbered(rows, ["match_id"], hour, ["ts", "event_id"], "t")
    seen = F.col("event_type") != "error"
    return rows.select(
        "match_id",
        F.expr("t + 90 * ((t - t % 400) div 400)").alias("frame_idx"),
        F.when(seen, F.expr("cast(140 + abs((t * 13) % 2000 - 1000) + (v % 5) - 2 as double)")).alias("x_px"),
        F.when(seen, F.expr("cast(80 + abs((t * 11) % 1120 - 560) + (((v - v % 5) div 5) % 5) - 2 as double)")).alias("y_px"),
        F.when(seen, F.expr("cast(50 + v % 50 as double) / 100d")).otherwise(0.0).alias("confidence"),
    )


def players(ball: DataFrame) -> DataFrame:
    """Five tracks on even frames, with holes; track 3 plays at the net. ball: whole matches of `ball_raw`, whose frames tell the rows' places t."""
    f = ball.select("match_id", "frame_idx", F.expr("frame_idx div 490 * 400 + frame_idx % 490").alias("t"))
    g = f.where("frame_idx % 2 = 0").select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    g = g.where("(t * 7 + k * 3) % 11 <> 0 and not (k = 5 and t % 3 = 0)")
    g = g.withColumn("foot_x_px", F.expr("cast(300 + 170 * (k - 1) + abs((t * (3 + k)) % 200 - 100) as double)"))
    g = g.withColumn("foot_y_px", F.expr("cast(case when k % 2 = 1 then 80 + 60 * k else 480 end + abs((t * (2 + k)) % 160 - 80) as double)"))
    x, y = to_court(F.col("foot_x_px"), F.col("foot_y_px"), homography())
    return g.select("match_id", "frame_idx", F.col("k").alias("track_id"), (F.col("k") - 1).alias("det_seq"), "foot_x_px", "foot_y_px", x.alias("foot_x_m"), y.alias("foot_y_m"))


def boxes(tracked: DataFrame) -> DataFrame:
    """Boxes, confidences and chunks for detections."""
    return tracked.select("*", F.expr("frame_idx div 2").alias("chunk_idx"), F.expr("foot_x_px - 20 - frame_idx % 7").alias("x1"), F.expr("foot_y_px - 150.5").alias("y1"), F.expr("foot_x_px + 20 + frame_idx % 5").alias("x2"), F.col("foot_y_px").alias("y2"), F.expr("cast(50 + (frame_idx * 7 + track_id * 13) % 50 as double) / 100d").alias("confidence"))


def poses(tracked: DataFrame) -> DataFrame:
    return tracked.where("frame_idx % 4 = 0").selectExpr(
        "match_id", "frame_idx", "track_id as pose_seq", "foot_x_px + (frame_idx % 7) * 25 - 60 as pose_foot_x_px", "foot_y_px as pose_foot_y_px",
        "foot_y_px - 140 as ls_y", "foot_y_px - 138 as rs_y", "foot_y_px - 140 - ((frame_idx + track_id) % 5) * 20 + 30 as lw_y", "foot_y_px - 120 as rw_y",
        "cast(frame_idx % 3 as double) / 3d as ls_c", "0.9d as rs_c", "cast(frame_idx % 10 as double) / 10d as lw_c", "0.5d as rw_c",
    )


def videos(events: DataFrame) -> DataFrame:
    """Five matches; the last has no detected corners."""
    return events.selectExpr("user_id % 5 as match_id", "cast(1280 as int) as width", "cast(720 as int) as height").distinct()


def corners(events: DataFrame) -> DataFrame:
    """Detected corners of matches 0 to 3, a sample every sixteen events, off by a few pixels and in turning order."""
    return events.selectExpr(
        "event_id % 4 as match_id", "event_id div 16 as sample", "(event_id div 4) % 4 as idx",
        "cast(element_at(array(281, 999, 1204, 76), cast(((event_id div 4) + (event_id div 16)) % 4 as int) + 1) + (event_id * 7) % 9 - 4 + 6 * (event_id % 4) as double) as x",
        "cast(element_at(array(72, 72, 669, 669), cast(((event_id div 4) + (event_id div 16)) % 4 as int) + 1) + (event_id * 5) % 7 - 3 + 3 * (event_id % 4) as double) as y",
        "(event_id div 16) % 6 = 5 as estimated",
    )


def match_list(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "cast(o_orderkey as string) as id", "concat('Match ', cast(o_orderkey as string)) as title",
        "case o_orderkey % 5 when 0 then 'uploading' when 1 then 'queued' when 2 then 'processing' when 3 then 'completed' else 'failed' end as status",
        "cast(case o_orderkey % 5 when 3 then 100 when 2 then o_orderkey % 100 else 0 end as int) as progress", "o_orderdate as created_at",
    )


def heat_cells(embeddings: DataFrame) -> DataFrame:
    """frame, col, row, w: vectors read as 8 x 8 confidence maps."""
    cells = embeddings.select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("pos", "e"))
    return cells.selectExpr("frame", "cast(pos % 8 as double) as col", "cast(pos div 8 as double) as row", "least(1d, abs(cast(e as double)) * 3) as w")


def candidates(events: DataFrame) -> DataFrame:
    """match_id, frame_idx, seq and shape of ball candidates, several to a frame."""
    return events.selectExpr(
        "user_id % 4 as match_id", "event_id div 3 as frame_idx", "event_id % 3 as seq", "cast(event_id * 7 % 500 as double) as area",
        "cast(10 + event_id * 11 % 60 as double) as perimeter", "cast(event_id * 13 % 100 as double) / 100d as brightness", "cast(event_id % 1280 as double) as x", "cast(event_id % 720 as double) as y",
    )


def mask_cells(events: DataFrame) -> DataFrame:
    """Set pixels of frames of 40 x 24, a square of nine for every fourth event and a single one for the others."""
    at = "(event_id * 37 + event_id div 7) % 38 as px", "event_id * 11 % 22 as py", "if(event_id % 4 = 0, 2, 0) as wide"
    rows = events.selectExpr("user_id % 4 as match_id", "event_id div 200 as frame_idx", *at)
    each = rows.select("match_id", "frame_idx", "px", "wide", F.explode(F.expr("sequence(py, py + wide)")).alias("y"))
    return each.select("match_id", "frame_idx", "y", F.explode(F.expr("sequence(px, px + wide)")).alias("x"))


#: Events of a clip, and the distance of its key frames.
CLIP, KEYS = 500, 12


def write_clips(events: DataFrame, folder: str) -> DataFrame:
    """clip, path: a video file of every CLIP events, whose encoded frames are the events' values as text."""

    def run(clip: pd.DataFrame) -> pd.DataFrame:
        clip = clip.sort_values("event_id")
        samples = [v.encode() for v in clip["payload"]]
        store, place = fs.FileSystem.from_uri(folder)
        path = f"{place}/{clip['clip'].iloc[0]}.mp4"
        store.create_dir(place)
        with store.open_output_stream(f"{path}.tmp") as out:
            out.write(mux(samples, [i % KEYS == 0 for i in range(len(samples))], 25, 1280, 720))
        store.move(f"{path}.tmp", path)  # a task that is run twice leaves one whole file
        return pd.DataFrame({"clip": [clip["clip"].iloc[0]], "path": [path]})

    rows = events.selectExpr(f"event_id div {CLIP} as clip", "event_id", "repeat(concat(event_type, ':', cast(event_id as string), ';'), cast(1 + event_id % 7 as int)) as payload")
    return rows.groupBy("clip").applyInPandas(run, "clip long, path string")
