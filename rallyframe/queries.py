"""All queries of the engine by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import SHOT_TYPES
from .functions import geometry
from .operators import courts, detection, joins, kinematics, masks, smoothing, tracking
from .operators import events as ev
from .operators import players as pl
from .plans import catalog, serving
from .plans.analysis import Analysis, analyse, stats_document, with_media
from .sources import adapters as src
from .sources import frames, media
from .storage import shared_dir, stored
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]
_RALLY = ("match_id", "rally_idx", "start_frame", "end_frame", "last_track", "last_player")


def _ball(spark: SparkSession, sf: str) -> DataFrame:
    return src.ball_raw(src.read(spark, sf, "events"))


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return kinematics.differences(_ball(spark, sf), src.homography())


def _players(spark: SparkSession, sf: str) -> DataFrame:
    return src.players(_ball(spark, sf))


def _analysis(spark: SparkSession, sf: str, share: bool = False) -> Analysis:
    """With `share`, the tracks are tables too, as they are outside of tests."""
    ball = _ball(spark, sf)
    if share:
        ball = stored(ball, "ball")
    players = src.players(ball)
    if share:
        players = stored(players, "players")
    return analyse(ball, players, src.homography(), src.poses(players), share=share)


def _tracked(spark: SparkSession, sf: str) -> DataFrame:
    players = _players(spark, sf)
    return pl.mapped(players, pl.player_map(players))


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return src.match_list(src.read(spark, sf, "orders"))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    names = "case when o_orderkey % 3 > 0 then array(concat('C', o_custkey), '') else null end"
    return src.read(spark, sf, "orders").selectExpr("cast(o_orderkey as string) as id", f"{names} as player_names")


def _crops(spark: SparkSession, sf: str) -> DataFrame:
    ball = _ball(spark, sf)
    chunks = ball.groupBy("match_id").agg((F.floor(F.max("frame_idx") / 2) + 1).alias("n_chunks"))
    players = src.players(ball)
    return pl.best_crops(src.boxes(pl.mapped(players, pl.player_map(players))), chunks)


def _r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


def ball_kinematics(spark: SparkSession, sf: str) -> DataFrame:
    return _steps(spark, sf).select("match_id", "frame_idx", "vx0", "vy0", F.round(kinematics.acceleration(), 6).alias("acceleration"))


def pixel_to_court(spark: SparkSession, sf: str) -> DataFrame:
    return _steps(spark, sf).select("match_id", "frame_idx", _r("cx"), _r("cy"))


def estimated_corners(spark: SparkSession, sf: str) -> DataFrame:
    sizes = src.read(spark, sf, "events").selectExpr("user_id % 16 as match_id", "1280 + 16 * (user_id % 16) as w", "720 + 8 * (user_id % 16) as h").distinct()
    corners = geometry.estimated_corners(F.col("w"), F.col("h"))
    each = F.array(*[F.struct(F.lit(n).alias("corner"), x.alias("x"), y.alias("y")) for n, (x, y) in zip(("tl", "tr", "br", "bl"), corners, strict=True)])
    return sizes.select("match_id", F.explode(each).alias("c")).select("match_id", "c.*")


def corner_order(spark: SparkSession, sf: str) -> DataFrame:
    points = src.read(spark, sf, "events").selectExpr("event_id div 4 as g", "event_id % 4 as idx", "event_id * 37 % 1280 as x", "event_id * 53 % 720 as y")
    return geometry.ordered_corners(points, ["g"])


def in_court_filter(spark: SparkSession, sf: str) -> DataFrame:
    feet = _players(spark, sf).selectExpr("match_id", "frame_idx", "track_id", "foot_x_px * 1.7d - 333.5d as fx", "foot_y_px * 1.5d - 97.7d as fy")
    corners = [(F.lit(float(x)), F.lit(float(y))) for x, y in ((281, 72), (999, 72), (1204, 669), (76, 669))]
    return feet.where(geometry.in_expanded_polygon(F.col("fx"), F.col("fy"), corners))


def sample_frames(spark: SparkSession, sf: str) -> DataFrame:
    videos = src.read(spark, sf, "events").groupBy(F.expr("user_id % 16").alias("match_id")).agg(F.count(F.lit(1)).alias("n_frames")).withColumn("fps", F.col("match_id") + 24.0)
    return detection.sample_frames(videos)


def ball_strided(spark: SparkSession, sf: str) -> DataFrame:
    return media.strided(_ball(spark, sf), 3).select("match_id", "frame_idx")


def foot_points(spark: SparkSession, sf: str) -> DataFrame:
    x, y = geometry.foot_point(F.col("x1"), F.col("x2"), F.col("y2"))
    return src.boxes(_tracked(spark, sf)).select("match_id", "frame_idx", "track_id", x.alias("x"), y.alias("y"))


def inference_control(spark: SparkSession, sf: str) -> DataFrame:
    return kinematics.inference_control(_ball(spark, sf), 2)


def hit_events(spark: SparkSession, sf: str) -> DataFrame:
    ball = _ball(spark, sf)
    peaks = kinematics.acceleration_peaks(kinematics.differences(ball, src.homography()))
    return joins.hits(peaks, src.players(ball)).select("match_id", "frame_idx", "track_id", "confidence")


def hit_events_pixels(spark: SparkSession, sf: str) -> DataFrame:
    ball = _ball(spark, sf)
    peaks = kinematics.acceleration_peaks(kinematics.differences(ball, src.homography()))
    return joins.hits(peaks, src.players(ball), calibrated=False).select("match_id", "frame_idx", "track_id")


def bounce_events(spark: SparkSession, sf: str) -> DataFrame:
    return kinematics.bounces(_steps(spark, sf)).select("match_id", "frame_idx", "x", "y")


def wall_hit_events(spark: SparkSession, sf: str) -> DataFrame:
    return kinematics.wall_hits(_steps(spark, sf)).select("match_id", "frame_idx", "x", "y")


def events_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return ev.ordered(_analysis(spark, sf).events).select("match_id", "type", "frame_idx", "track_id")


def rallies(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf).rallies.select(*_RALLY)


def rallies_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    ball = _ball(spark, sf)
    return analyse(ball, src.players(ball), src.homography(), smooth=True).rallies.select(*_RALLY)


def calibration_table(spark: SparkSession, sf: str) -> DataFrame:
    videos, corners = src.videos(src.read(spark, sf, "events")), src.corners(src.read(spark, sf, "events"))
    entry = F.posexplode(F.flatten("homography")).alias("entry", "value")
    return detection.calibrations(corners, videos).select("match_id", "estimated", entry).withColumn("value", F.round("value", 6) + 0.0)  # no negative zeros


def calibrated_rallies(spark: SparkSession, sf: str) -> DataFrame:
    ball = _ball(spark, sf)
    found = detection.calibrations(src.corners(src.read(spark, sf, "events")), src.videos(src.read(spark, sf, "events")))
    return analyse(ball, src.players(ball), stored(found, "calibrations")).rallies.select(*_RALLY)


def player_map(spark: SparkSession, sf: str) -> DataFrame:
    return pl.player_map(_players(spark, sf))


def player_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf).distances()


def player_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return pl.heatmap(_tracked(spark, sf)).withColumn("weight", F.round("weight", 6))


def rally_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf, share=True).outcomes.select("match_id", "rally_idx", "outcome")


def winners_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf, share=True).winners_errors()


def shot_features(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf, share=True).features.withColumns({c: F.round(c, 6) for c in ("median_y", "speed_px", "speed_ms")})


def shot_types(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf, share=True).shots


def shot_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return _analysis(spark, sf, share=True).crosstab()


def gap_runs(spark: SparkSession, sf: str) -> DataFrame:
    return kinematics.gap_runs(_ball(spark, sf))


def kalman_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return smoothing.kalman_smooth(_ball(spark, sf)).withColumns({c: F.round(c, 4) for c in ("x_px", "y_px")})


def kalman_live(spark: SparkSession, sf: str) -> DataFrame:
    """The tracks as a stream through state that lives between micro-batches."""
    found = live.replay(_ball(spark, sf), live.live_kalman, ["match_id"])
    return found.withColumns({c: F.round(c, 4) for c in ("x_px", "y_px")})


def events_live(spark: SparkSession, sf: str) -> DataFrame:
    ball = _ball(spark, sf)
    steps = kinematics.differences(ball, src.homography())
    found = joins.detected_events(steps, src.players(ball)).select("match_id", "type", "frame_idx", "x", "y", "track_id", "confidence")
    return live.replay(found, live.live_dedup, ["match_id", "type"]).select("match_id", "type", "frame_idx", "track_id")


def player_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks of the players' boxes by overlap, without the ids they were made with."""
    return tracking.track_boxes(src.boxes(_players(spark, sf)))


def quadratic_fill(spark: SparkSession, sf: str) -> DataFrame:
    # The generated positions are whole, so fits hit halves of the last digit; the shift rounds these alike everywhere.
    return smoothing.quadratic_fill(_ball(spark, sf)).withColumns({c: F.round(F.col(c) + 1e-6, 2) for c in ("x_px", "y_px")})


def pose_match(spark: SparkSession, sf: str) -> DataFrame:
    players = _players(spark, sf)
    return joins.match_poses(src.poses(players), players)


def pose_targets(spark: SparkSession, sf: str) -> DataFrame:
    return joins.pose_targets(_ball(spark, sf))


def best_crop(spark: SparkSession, sf: str) -> DataFrame:
    return _crops(spark, sf).select("match_id", "player_id", "frame_idx", _r("score"))


def crop_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return pl.crop_boxes(_crops(spark, sf), 1280, 720)


def heatmap_centroid(spark: SparkSession, sf: str) -> DataFrame:
    cells = src.heat_cells(src.read(spark, sf, "embeddings"))
    return detection.heatmap_positions(cells, 160.0, 90.0).select("frame", _r("x"), _r("y"), _r("confidence"))


def ball_candidate_best(spark: SparkSession, sf: str) -> DataFrame:
    found = src.candidates(src.read(spark, sf, "events"))
    return detection.best_candidates(found.select("match_id", "frame_idx").distinct(), found).withColumn("confidence", F.round("confidence", 6))


def mask_opened(spark: SparkSession, sf: str) -> DataFrame:
    return masks.opened(masks.mask_runs(src.mask_cells(src.read(spark, sf, "events"))), masks.SMALL_ELLIPSE)


def mask_components(spark: SparkSession, sf: str) -> DataFrame:
    found = masks.components(masks.opened(masks.mask_runs(src.mask_cells(src.read(spark, sf, "events"))), masks.SMALL_ELLIPSE))
    return found.select("match_id", "frame_idx", "component", "n_pixels", "left", "top", "right", "bottom")


def court_lines(spark: SparkSession, sf: str) -> DataFrame:
    return courts.lines(courts.line_votes(src.mask_cells(src.read(spark, sf, "events")).distinct(), least=9), 9)


def median_corners(spark: SparkSession, sf: str) -> DataFrame:
    place = ("cast(event_id * 37 % 1280 as double) as x", "cast(event_id * 53 % 720 as double) as y")
    rows = src.read(spark, sf, "events").selectExpr("user_id % 4 as match_id", "event_id % 4 as corner", *place, "event_type = 'error' as estimated")
    return detection.median_corners(rows)


def court_strategy(spark: SparkSession, sf: str) -> DataFrame:
    found = ("case when event_id % 3 = 0 then event_id % 1280 end as lines", "case when event_id % 4 = 0 then event_id % 640 end as colour")
    rows = src.read(spark, sf, "events").selectExpr("event_id as match_id", *found)
    name = detection.first_success(F.when(F.col("lines").isNotNull(), "lines"), F.when(F.col("colour").isNotNull(), "colour"), F.lit("estimated"))
    return rows.select("match_id", name.alias("strategy"), detection.first_success(F.col("lines"), F.col("colour"), F.lit(0)).alias("corner_x"))


def match_list_topk(spark: SparkSession, sf: str) -> DataFrame:
    return serving.latest(_matches(spark, sf))


def match_read(spark: SparkSession, sf: str) -> DataFrame:
    return serving.lookup(_matches(spark, sf), "37").drop("created_at")


def stats_read_totals(spark: SparkSession, sf: str) -> DataFrame:
    return serving.stats_read(stats_document(_analysis(spark, sf, share=True))).select("match_id", "total_shots", F.col("rallies_count").cast("long").alias("rallies_count"))


def stats_players(spark: SparkSession, sf: str) -> DataFrame:
    each = stats_document(_analysis(spark, sf, share=True)).select("match_id", F.explode("per_player").alias("player", "s"))
    shots = F.aggregate(F.map_values("s.shots"), F.lit(0).cast("long"), lambda a, n: a + n)
    return each.select("match_id", F.col("player").cast("int").alias("player_id"), "s.distance_m", "s.winners", "s.errors", shots.alias("shots"))


def shot_share(spark: SparkSession, sf: str) -> DataFrame:
    return serving.shot_shares(stored(_analysis(spark, sf, share=True).crosstab(), "crosstab")).withColumn("share", F.round("share", 6))


def shot_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return serving.shot_pivot(_analysis(spark, sf, share=True).crosstab(), SHOT_TYPES)


def summary_cards(spark: SparkSession, sf: str) -> DataFrame:
    return serving.summary_cards(stats_document(_analysis(spark, sf, share=True)))


def heat_marks(spark: SparkSession, sf: str) -> DataFrame:
    return serving.heat_marks(pl.heatmap(_tracked(spark, sf))).select("match_id", "player_id", "x", "y", _r("radius"), _r("opacity"))


def display_names(spark: SparkSession, sf: str) -> DataFrame:
    return serving.display_names(_named(spark, sf))


def any_name(spark: SparkSession, sf: str) -> DataFrame:
    return serving.any_name(_named(spark, sf))


def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    matches = _matches(spark, sf)
    return catalog.delete(matches, matches.where("status = 'failed'")).select("id", "status")


def cascade_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that stay of the matches and of a dependent table when failed matches go."""
    matches = _matches(spark, sf)
    lines = src.read(spark, sf, "lineitem").selectExpr("cast(l_orderkey as string) as match_id")
    kept = catalog.delete_cascade(matches.where("status = 'failed'"), matches, lines=lines)
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in kept.items()]
    return counts[0].unionByName(counts[1])


def process_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Queued matches, of which the last two have no tracks and one of these an error, through analysis, calibration, crops and the store of results."""
    jobs = spark.range(6).selectExpr("cast(id as string) as id", "if(id = 1, 'failed', 'queued') as status", "0 as progress", "cast(null as string) as error_message")
    path = f"{shared_dir(spark)}/match_stats"

    def analysis(begun: DataFrame) -> tuple[DataFrame, DataFrame]:
        ball = stored(_ball(spark, sf).join(begun.select("match_id"), "match_id", "left_semi"), "ball")
        players = stored(src.players(ball), "players")
        documents = stats_document(analyse(ball, players, src.homography(), src.poses(players), share=True))
        courts_ = detection.calibrations(src.corners(src.read(spark, sf, "events")), src.videos(src.read(spark, sf, "events")))
        crops = pl.player_map(players).selectExpr("match_id", "player_id", "concat('crops/', match_id, '/', player_id, '.jpg') as key")
        errors = begun.where("match_id = 5").selectExpr("id", "'OSError: no such video' as message")
        return with_media(documents, courts_, crops), errors

    after = catalog.run_jobs(jobs, analysis, path)
    saved = catalog.load_stats(spark, path)
    media_ = saved.select(F.col("match_id").cast("string").alias("id"), F.size("player_crops").alias("crops"), F.col("court_calibration.estimated").alias("estimated"))
    read = serving.stats_read(saved).select(F.col("match_id").cast("string").alias("id"), "total_shots", F.col("rallies_count").cast("long").alias("rallies_count"))
    return after.join(read, "id", "left").join(media_, "id", "left")


def progress_log(spark: SparkSession, sf: str) -> DataFrame:
    updates = src.read(spark, sf, "events").selectExpr("user_id % 64 as match_id", "event_id as seq", "cast(event_id * 37 % 101 as int) as progress")
    return catalog.job_log(updates)


def frame_index(spark: SparkSession, sf: str) -> DataFrame:
    """Files written from the events, and their frames read by ranges of bytes."""
    folder = f"{shared_dir(spark)}/clips"
    src.write_clips(src.read(spark, sf, "events"), folder).write.format("noop").mode("overwrite").save()
    found = frames.read_frames(spark, folder, ("path", "frame_idx", "group", "key", "seconds", "size", "data"), split_bytes=8192)
    clip = F.regexp_extract("path", r"(\d+)\.mp4$", 1).cast("long")
    return found.select(clip.alias("clip"), "frame_idx", F.col("group").alias("key_frame"), "key", _r("seconds"), "size", F.md5("data").alias("digest"))


def frame_range(spark: SparkSession, sf: str) -> DataFrame:
    """Every third frame of a range, the bytes of no other frame being read."""
    folder = f"{shared_dir(spark)}/clips"
    src.write_clips(src.read(spark, sf, "events"), folder).write.format("noop").mode("overwrite").save()
    found = frames.read_frames(spark, folder, ("path", "frame_idx", "data"), first=100, last=250, stride=3, split_bytes=8192)
    clip = F.regexp_extract("path", r"(\d+)\.mp4$", 1).cast("long")
    return found.select(clip.alias("clip"), "frame_idx", F.decode("data", "utf-8").alias("payload"))


def stats_saved(spark: SparkSession, sf: str) -> DataFrame:
    """Results saved, some of them again, and read back."""
    path = f"{shared_dir(spark)}/saved"
    rows = src.read(spark, sf, "customer").selectExpr("cast(c_custkey as string) as match_id", "c_nationkey as v")
    catalog.save_stats(rows, path)
    catalog.save_stats(rows.where("v % 3 = 0").selectExpr("match_id", "v + 100 as v", "1 as later"), path)
    return catalog.load_stats(spark, path).select("match_id", "v", "later")


def match_with_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = src.read(spark, sf, "lineitem").where("l_orderkey % 3 = 0").groupBy(F.col("l_orderkey").cast("string").alias("match_id")).agg(F.count(F.lit(1)).alias("total_shots"))
    return serving.with_stats(_matches(spark, sf), stats).select("id", "status", "total_shots")


def crop_urls(spark: SparkSession, sf: str) -> DataFrame:
    crops = "case when o_orderkey % 2 = 0 then map_from_arrays(array('0', cast(1 + o_custkey % 3 as string)), array('a', 'b')) end"
    stats = src.read(spark, sf, "orders").selectExpr("cast(o_orderkey as string) as match_id", f"{crops} as player_crops")
    return serving.with_crop_urls(stats, "http://host/api/").select("match_id", F.explode("crop_urls").alias("player", "url"))


def players_by_number(spark: SparkSession, sf: str) -> DataFrame:
    keys = "array('10', cast(o_custkey % 9 as string), '9')"
    rows = src.read(spark, sf, "orders").where("o_custkey % 9 < 9").selectExpr("o_orderkey as match_id", f"map_from_arrays({keys}, array(1L, 2L, 3L)) as m")
    return rows.select("match_id", F.posexplode(serving.by_player_number("m", "long")).alias("place", "e")).select("match_id", "place", F.col("e.n").alias("player"), F.col("e.value").alias("value"))


def stats_dump(spark: SparkSession, sf: str) -> DataFrame:
    stats = src.read(spark, sf, "orders").selectExpr("o_orderkey as match_id", "o_custkey as total", "array(o_orderkey, 1L) as rallies", "o_orderstatus as status")
    return serving.to_document(stats)


def job_transitions(spark: SparkSession, sf: str) -> DataFrame:
    actions = "element_at(array('start', 'begin', 'finish', 'fail', 'retry'), cast(o_custkey % 5 as int) + 1)"
    requests = src.read(spark, sf, "orders").selectExpr("cast(case when o_orderkey % 7 = 0 then -o_orderkey else o_orderkey end as string) as id", f"{actions} as action")
    return catalog.transitions(_matches(spark, sf), requests)


def upload_check(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.accepts_upload(src.read(spark, sf, "orders").selectExpr("cast(o_orderkey as string) as id", "o_orderkey * 1000000 - 5000000 as size_bytes"))


_ALL = (
    ball_kinematics, pixel_to_court, estimated_corners, corner_order, in_court_filter, sample_frames, inference_control, hit_events, hit_events_pixels,
    bounce_events, wall_hit_events, events_dedup, rallies, rallies_smoothed, player_map, player_distance, player_heatmap, rally_outcomes, winners_errors,
    calibration_table, calibrated_rallies, ball_strided, foot_points, cascade_counts, frame_index, frame_range, process_jobs, progress_log, stats_saved, match_with_stats, crop_urls,
    players_by_number, stats_dump, shot_features, shot_types, shot_crosstab, gap_runs, kalman_smooth, kalman_live, events_live, player_tracks, quadratic_fill, pose_match, pose_targets, best_crop, crop_bbox, heatmap_centroid,
    ball_candidate_best, mask_opened, mask_components, court_lines, median_corners, court_strategy, match_list_topk, match_read, stats_read_totals, stats_players, shot_share, shot_pivot,
    summary_cards, heat_marks, display_names, any_name, delete_cascade, job_transitions, upload_check,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _ALL}
