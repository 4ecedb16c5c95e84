"""Hand-made cases, one or more for each rule whose naive form goes wrong."""

import json
import math
import urllib.request

import pytest
from pyspark.sql import functions as F

from rallyframe import schemas
from rallyframe.config import DEFAULT
from rallyframe.functions import geometry as g
from rallyframe.operators import detection, joins, kinematics, outcomes, shots, smoothing
from rallyframe.operators import events as ev
from rallyframe.operators import players as pl
from rallyframe.plans import catalog, serving
from rallyframe.plans.analysis import analyse, stats_document
from rallyframe.sources import adapters, media

H = adapters.HOMOGRAPHY


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def events(spark, *items):
    """items: (frame, type, track)."""
    return spark.createDataFrame([(0, f, k, 1.0, 2.0, t, 0.5) for f, k, t in items], schemas.EVENTS)


def ball(spark, ys, start=0):
    return spark.createDataFrame([(0, start + i, None if y is None else 100.0, y, 0.9) for i, y in enumerate(ys)], schemas.BALL)


def player_rows(spark, *items):
    """items: (frame, track, seq, x_m, y_m)."""
    return spark.createDataFrame([(0, f, t, s, 10.0 * x, 10.0 * y, float(x), float(y)) for f, t, s, x, y in items], schemas.PLAYERS)


# Rallies and deduplication


def test_a_pause_of_60_joins_and_61_splits(spark):
    got = ev.rallies(events(spark, (0, "hit", 1), (60, "bounce", None), (121, "bounce", None), (125, "hit", 2), (130, "bounce", None)))
    assert rows(got, "start_frame", "end_frame") == [(0, 60), (121, 130)]
    assert {r.start_frame: r.last_track for r in got.collect()} == {0: 1, 121: 2}


def test_the_last_hitter_starts_anew(spark):
    got = ev.rallies(events(spark, (0, "hit", 1), (100, "bounce", None)))
    assert {r.start_frame: r.last_track for r in got.collect()} == {0: 1, 100: None}


def test_dedup_scans_from_the_last_kept(spark):
    got = ev.dedup_events(events(spark, *[(f, "hit", 1) for f in (1, 5, 9, 12, 17, 18, 30)], (2, "bounce", None), (1, "hit", 2)))
    assert rows(got, "type", "frame_idx") == [("bounce", 2), ("hit", 1), ("hit", 9), ("hit", 17), ("hit", 30)]


def test_no_events(spark):
    none = spark.createDataFrame([], schemas.EVENTS)
    assert ev.dedup_events(none).count() == 0 and ev.rallies(none).count() == 0


# Kinematics


def test_differences_skip_hidden_rows(spark):
    steps = kinematics.differences(ball(spark, [0.0, None, 5.0, 9.0]), adapters.homography())
    assert rows(steps, "frame_idx", "n_visible") == [(0, 3), (2, 3), (3, 3)]
    assert {r.frame_idx: (r.vy0, r.vy1) for r in steps.collect()}[2] == (5.0, 4.0)


def test_four_visible_rows_have_no_events(spark):
    for ys, n in (([0.0, 50.0, 0.0, 50.0], 0), ([0.0, 50.0, 0.0, 50.0, 0.0], 3)):
        steps = kinematics.differences(ball(spark, ys), adapters.homography())
        assert kinematics.acceleration_peaks(steps).count() == n


def test_bounce_threshold_follows_the_frame_rate(spark):
    steps = kinematics.differences(ball(spark, [0.0, 5.0, 0.0, -9.0, -9.0]), adapters.homography())
    assert rows(kinematics.bounces(steps, 30.0), "frame_idx") == [(1,)]
    assert kinematics.bounces(steps, 60.0).count() == 0


def test_gap_runs(spark):
    got = kinematics.gap_runs(ball(spark, [None, 1.0, None, None, 2.0, None]))
    assert rows(got) == [(0, 0, 0, 1, False), (0, 2, 3, 2, True), (0, 5, 5, 1, False)]


def test_three_frame_buffer(spark):
    got = kinematics.inference_control(ball(spark, [1.0] * 6), 2)
    assert [r.infer for r in got.orderBy("frame_idx").collect()] == [False, False, True, False, True, False]


# Joins


def test_nearest_frame_prefers_exact_then_forward(spark):
    peaks = spark.createDataFrame([(0, f, 0.0, 0.0, 0.0, 0.0) for f in (10, 20, 40)], "match_id long, frame_idx long, x double, y double, cx double, cy double")
    players = player_rows(spark, (8, 1, 0, 0, 0), (12, 2, 0, 1, 1), (14, 3, 0, 0, 0), (26, 4, 0, 0, 0), (33, 5, 0, 0, 0))
    assert rows(joins.hits(peaks, players), "frame_idx", "track_id") == [(10, 2), (20, 4)]


def test_frame_first_then_player_and_first_detection_wins(spark):
    peaks = spark.createDataFrame([(0, 10, 0.0, 0.0, 0.0, 0.0)], "match_id long, frame_idx long, x double, y double, cx double, cy double")
    far = player_rows(spark, (10, 1, 0, 9, 9), (11, 2, 0, 0, 0))
    assert joins.hits(peaks, far).count() == 0
    tie = player_rows(spark, (10, 7, 1, 1, 0), (10, 8, 0, 0, 1))
    assert rows(joins.hits(peaks, tie), "track_id", "confidence") == [(8, 0.8)]


def test_proximity_is_strict(spark):
    peaks = spark.createDataFrame([(0, 10, 0.0, 0.0, 0.0, 0.0)], "match_id long, frame_idx long, x double, y double, cx double, cy double")
    assert joins.hits(peaks, player_rows(spark, (10, 1, 0, 2.5, 0))).count() == 0


@pytest.mark.parametrize("bucket", [4, 64, 10_000])
def test_bucketed_interval_join_finds_each_row_once(spark, bucket):
    left = spark.range(0, 200, 7).selectExpr("id % 2 as match_id", "id as frame_idx")
    right = spark.range(0, 200).selectExpr("id % 2 as match_id", "id as frame_idx", "id as v")
    got = rows(joins.interval_join(left, right, 12, 6, bucket=bucket), "frame_idx", "r_v")
    assert got == sorted((f, v) for f in range(0, 200, 7) for v in range(200) if v % 2 == f % 2 and f - 12 <= v <= f + 6)


def test_a_later_pose_overwrites(spark):
    players = player_rows(spark, (4, 1, 0, 0, 0))
    pose = lambda seq, x: (0, 4, seq, x, 0.0, *[0.0] * 8)
    poses = spark.createDataFrame([pose(0, 5.0), pose(1, 100.0), pose(2, 120.0)], schemas.POSES)
    assert rows(joins.match_poses(poses, players)) == [(0, 4, 1, 1)]


def test_pose_targets(spark):
    got = rows(joins.pose_targets(ball(spark, [None, 1.0, 1.0], start=10)), "frame_idx")
    assert got == [(f,) for f in range(7, 17)]


# Players


def test_canonical_players_and_first_appearance(spark):
    players = player_rows(spark, (0, 5, 1, 0, 0), (0, 4, 0, 0, 0), (1, 9, 0, 0, 0), (1, 9, 1, 0, 0), (2, 1, 0, 0, 0), (3, 2, 0, 0, 0))
    assert rows(pl.player_map(players), "player_id", "track_id") == [(0, 9), (1, 4), (2, 5), (3, 1)]


def test_a_teleport_is_dropped_but_moves_on(spark):
    players = player_rows(spark, (0, 1, 0, 0, 0), (1, 1, 0, 1, 0), (2, 1, 0, 6, 0), (3, 1, 0, 7, 0))
    got = pl.distances(pl.mapped(players, pl.player_map(players)))
    assert rows(got, "distance_m") == [(2.0,)]


def test_heat_floor_is_strict_and_not_normalised(spark):
    cells = [(f, 1, 0, 5.0, 5.0) for f in range(998)] + [(2000, 1, 0, -3.0, 99.0), (2001, 1, 0, 2.0, 2.0)]
    players = player_rows(spark, *cells)
    assert rows(pl.heatmap(pl.mapped(players, pl.player_map(players))), "x", "y", "weight") == [(5.5, 5.5, 0.998)]
    fewer = player_rows(spark, *cells[:900], *cells[998:])
    assert len(rows(pl.heatmap(pl.mapped(fewer, pl.player_map(fewer))))) == 3


def test_crops_prefer_the_middle_third(spark):
    kind = "match_id long, player_id int, frame_idx long, chunk_idx long, det_seq int, confidence double, x1 double, y1 double, x2 double, y2 double"
    data = [(0, 0, 2 * c, c, 0, conf, 30.9, 10.0, 60.9, 700.0) for c, conf in ((0, 0.9), (3, 0.5), (4, 0.5), (8, 0.95))]
    best = pl.best_crops(spark.createDataFrame(data, kind), spark.createDataFrame([(0, 9)], "match_id long, n_chunks int"))
    assert rows(best, "frame_idx", "score") == [(6, 1.0)]
    assert rows(pl.crop_boxes(best, 1280, 720), "left", "top", "right", "bottom") == [(6, 0, 84, 720)]


# Outcomes


def outcome(spark, positions):
    rallies = spark.createDataFrame([(0, 0, 0, 100, 1)], "match_id long, rally_idx long, start_frame long, end_frame long, last_track int")
    where = spark.createDataFrame([(0, f, float(x), float(y)) for f, x, y in positions], "match_id long, frame_idx long, cx double, cy double")
    return rows(outcomes.rally_outcomes(rallies, where), "outcome")[0][0]


def test_the_last_position_around_the_end_decides(spark):
    assert outcome(spark, [(80, 0.1, 5), (110, 5, 5), (111, 0.1, 5)]) == "winner"
    assert outcome(spark, [(100, 5, 5), (105, 9.41, 5)]) == "error"
    assert outcome(spark, [(100, 0.6, 5)]) == "winner"
    assert outcome(spark, [(79, 5, 5), (111, 5, 5)]) == "unknown"


def test_counts_are_dense(spark):
    players = player_rows(spark, (0, 1, 0, 0, 0), (0, 2, 1, 0, 0))
    mapping = pl.player_map(players)
    shot = spark.createDataFrame([(0, 5, 1, "smash", 0.8), (0, 9, 77, "smash", 0.8), (0, 9, None, "other", 0.0)], schemas.SHOTS)
    got = rows(outcomes.shot_crosstab(shot, mapping), "player_id", "shot_type", "n")
    assert len(got) == 16 and sum(n for *_, n in got) == 1 and (0, "smash", 1) in got


def test_an_unmapped_last_hitter_keeps_its_rally(spark):
    rallies = spark.createDataFrame([(0, 0, 0, 9, 77), (0, 1, 90, 99, None)], "match_id long, rally_idx long, start_frame long, end_frame long, last_track int")
    mapping = spark.createDataFrame([(0, 1, 0)], "match_id long, track_id int, player_id int")
    assert [r.last_player for r in outcomes.rally_players(rallies, mapping).collect()] == [None, None]


# Shots


FEATURES = "match_id long, frame_idx long, track_id int, speed_px double, speed_ms double, ball_high boolean, at_net boolean, at_back boolean, arm_above boolean, arm_high boolean"


def test_rules_in_order(spark):
    cases = [
        ((1, 0.0, 0.0, True, False, False, True, True), ("smash", 0.82)),
        ((1, 0.0, 18.1, True, True, False, False, False), ("smash", 0.62)),
        ((1, 0.0, 18.0, True, False, True, False, True), ("bandeja", 0.65)),
        ((1, 0.0, 6.1, True, False, True, False, False), ("bandeja", 0.50)),
        ((1, 0.0, 0.0, False, True, False, False, False), ("volley", 0.60)),
        ((1, 0.0, 6.1, False, True, False, True, True), ("volley", 0.45)),
        ((1, 0.0, 6.0, False, True, False, True, True), ("other", 0.40)),
        ((None, 99.0, 99.0, True, True, True, True, True), ("other", 0.0)),
    ]
    df = spark.createDataFrame([(0, i, *c) for i, (c, _) in enumerate(cases)], FEATURES)
    got = {r.frame_idx: (r.shot_type, r.confidence) for r in shots.classify(df).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def features(spark, ys, hit, **kw):
    steps = kinematics.differences(ball(spark, ys), adapters.homography())
    hits = spark.createDataFrame([(0, hit, "hit", 100.0, 200.0, 1, 0.8)], schemas.EVENTS)
    return shots.shot_features(hits, kw.get("players", player_rows(spark)), steps).collect()[0]


def player_table(spark, *items):
    return player_rows(spark, *items)


def test_a_median_of_zero_counts_as_none(spark):
    none = spark.createDataFrame([], schemas.PLAYERS)
    assert not features(spark, [0.0, 0.0, 0.0, 200.0], 3, players=none).ball_high
    assert features(spark, [0.0, 5.0, 6.0, 200.0], 3, players=none).ball_high


def test_features_without_neighbours(spark):
    got = features(spark, [200.0], 0, players=spark.createDataFrame([], schemas.PLAYERS))
    assert (got.median_y, got.speed_px, got.speed_ms, got.at_net, got.at_back) == (None, 0.0, 0.0, False, False)


def test_position_is_that_of_the_very_frame(spark):
    for frame, net in ((3, True), (4, False)):
        players = player_rows(spark, (frame, 1, 0, 5, 10))
        assert features(spark, [1.0] * 6, 3, players=players).at_net is net


def test_arms(spark):
    kind = "ls_y double, rs_y double, lw_y double, rw_y double, ls_c double, rs_c double, lw_c double, rw_c double"
    cases = {(100.0, 90.0, 60.0, 500.0, 0.9, 0.9, 0.5, 0.5): (True, True), (100.0, 90.0, 100.0, 0.0, 0.9, 0.9, 0.5, 0.4): (False, True), (100.0, 90.0, 100.0, 0.0, 0.9, 0.35, 0.5, 0.4): (True, True), (100.0, 90.0, 0.0, 0.0, 0.9, 0.9, 0.35, 0.2): (False, False)}
    got = spark.createDataFrame(list(cases), kind).select(*shots.arm_features()).collect()
    assert [tuple(r) for r in got] == list(cases.values())


# Smoothing


def test_kalman_fills_the_first_rows_of_any_gap(spark):
    got = smoothing.kalman_smooth(ball(spark, [None, 10.0, None, None, None, 20.0]), 2).orderBy("frame_idx").collect()
    assert [r.confidence for r in got] == [0.3, 0.9, 0.3, 0.3, 0.9, 0.9]
    assert got[0].y_px == 10.0 and got[4].y_px is None


def test_quadratic_fills_whole_interior_gaps(spark):
    ys = [float(i * i) for i in range(12)]
    holes = [None, *ys[1:4], None, None, *ys[6:9], None, None, None, ys[11], None]
    got = smoothing.quadratic_fill(ball(spark, [*holes[:12], ys[11], None]), 2).orderBy("frame_idx").collect()
    assert [round(r.y_px, 6) for r in got[4:6]] == [16.0, 25.0] and got[4].confidence == 0.3
    assert got[0].y_px is None and got[9].y_px is None and got[-1].y_px is None


def test_two_points_are_joined_by_a_line(spark):
    got = smoothing.quadratic_fill(ball(spark, [2.0, None, 6.0]), 1).orderBy("frame_idx").collect()
    assert got[1].y_px == 4.0


def test_nothing_visible(spark):
    empty = ball(spark, [None, None])
    assert [r.y_px for r in smoothing.kalman_smooth(empty).collect()] == [None, None]


# Geometry and detection


def test_homography_of_the_estimated_corners():
    corners = [(281, 72), (999, 72), (1204, 669), (76, 669)]
    assert all(abs(a - b) < 1e-9 for r, s in zip(g.fit_homography(corners), H, strict=True) for a, b in zip(r, s, strict=True))


def test_a_vanishing_denominator_gives_zero(spark):
    h = g.literal_homography([[1, 0, 0], [0, 1, 0], [1, 0, 0]])
    x, y = g.to_court(F.col("x"), F.col("y"), h)
    got = spark.createDataFrame([(0.0, 5.0), (2.0, 4.0), (None, 1.0)], "x double, y double").select(x.alias("a"), y.alias("b")).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (1.0, 2.0), (None, None)]


def test_corner_ties_go_to_the_first(spark):
    points = spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate([(0, 1), (1, 0), (9, 0), (9, 9), (0, 9)])], "k int, idx int, x int, y int")
    assert {(r.corner, r.x, r.y) for r in g.ordered_corners(points, ["k"]).collect()} == {("tl", 0, 1), ("tr", 9, 0), ("br", 9, 9), ("bl", 0, 9)}


def test_feet_outside_the_court(spark):
    square = [(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (100, 0), (100, 100), (0, 100))]
    out = 100 + 50 / math.sqrt(2)
    data = [(50.0, 50.0, True), (out - 0.1, 50.0, True), (out + 0.1, 50.0, False), (-40.0, -40.0, False)]
    got = spark.createDataFrame(data, "x double, y double, want boolean").withColumn("got", g.in_expanded_polygon(F.col("x"), F.col("y"), square))
    assert got.where("got <> want").count() == 0


def test_heatmap_peak_and_floor(spark):
    cells = spark.createDataFrame([(0, 1.0, 1.0, 0.5), (0, 3.0, 1.0, 0.5), (0, 9.0, 9.0, 0.3), (1, 1.0, 1.0, 0.49)], "frame int, col double, row double, w double")
    assert [tuple(r) for r in detection.heatmap_positions(cells, 10.0, 10.0).orderBy("frame").collect()] == [(0, 20.0, 10.0, 0.5), (1, None, None, 0.49)]


def test_a_frame_without_a_good_candidate_has_no_confidence(spark):
    frames = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "match_id long, frame_idx long")
    kind = "match_id long, frame_idx long, seq int, area double, perimeter double, brightness double, x double, y double"
    round_ = (100.0, 35.45, 1.0)
    found = spark.createDataFrame([(0, 1, 0, *round_, 5.0, 6.0), (0, 2, 0, 100.0, 90.0, 0.1, 7.0, 8.0)], kind)
    got = {r.frame_idx: (r.x, r.confidence) for r in detection.best_candidates(frames, found).collect()}
    assert got == {1: (5.0, 0.85), 2: (None, 0.0), 3: (None, 0.0)}


def test_short_videos_are_sampled_too(spark):
    videos = spark.createDataFrame([(0, 0.1, 3), (1, 30.0, 1000)], "match_id long, fps double, n_frames long")
    got = rows(detection.sample_frames(videos), "match_id", "frame_idx")
    assert max(f for m, f in got if m == 0) == 2 and max(f for m, f in got if m == 1) == 149 and len(got) == 60


# Catalog, serving, sources


def test_repeated_jobs_leave_one_result(spark, tmp_path):
    path = f"file://{tmp_path}/stats"
    for value in (1, 2):
        catalog.save_stats(spark.createDataFrame([("a", value)], "match_id string, v int"), path)
    catalog.save_stats(spark.createDataFrame([("b", 9)], "match_id string, v int"), path)
    assert rows(catalog.load_stats(spark, path), "match_id", "v") == [("a", 2), ("b", 9)]


def test_progress_is_throttled(spark):
    updates = spark.createDataFrame([(0, i, p) for i, p in enumerate((0, 2, 5, 9, 10, 97, 99, 100, 100))], "match_id long, seq int, progress int")
    assert sorted(r.progress for r in catalog.job_log(updates).collect()) == [5, 10, 97, 100, 100]


def test_upload_limits_and_validation(spark):
    sizes = spark.createDataFrame([("a", 0), ("b", 2048 << 20), ("c", (2048 << 20) + 1)], "id string, size_bytes long")
    assert rows(catalog.accepts_upload(sizes), "id", "code") == [("a", 422), ("b", 200), ("c", 413)]
    matches = spark.createDataFrame([("a", "t", "queued", None), ("b", "", "queued", None), ("c", "t", "odd", None), ("d", "t", "failed", list("12345"))], "id string, title string, status string, player_names array<string>")
    assert rows(catalog.valid_matches(matches), "id") == [("a",)]


def two_matches(spark):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    data = [(i, start + datetime.timedelta(seconds=i), i % 2, "error" if i % 11 == 0 else "view", float(i * 7 % 83), "{}") for i in range(1600)]
    return spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")


def test_matches_together_equal_matches_apart(spark):
    events_ = two_matches(spark)
    run = lambda e: rows(_document(e))

    def _document(e):
        b = adapters.ball_raw(e)
        p = adapters.players(b)
        return stats_document(analyse(b, p, adapters.homography(), adapters.poses(p))).select("match_id", F.to_json(F.struct("per_player", "heatmaps", "rallies")).alias("j"))

    assert run(events_) == sorted(run(events_.where("user_id = 0")) + run(events_.where("user_id = 1")))


def test_documents_and_views(spark):
    b = adapters.ball_raw(two_matches(spark))
    p = adapters.players(b)
    a = analyse(b, p, adapters.homography(), adapters.poses(p))
    stats = stats_document(a)
    document = json.loads(serving.to_document(stats).first()["document"])
    assert set(document["per_player"]) == {"0", "1", "2", "3"} and set(document["per_player"]["0"]["shots"]) == {"smash", "volley", "bandeja", "other"}
    read = serving.stats_read(stats).first()
    assert read.total_shots == sum(sum(x["shots"].values()) for x in read.per_player.asDict().values()) if not isinstance(read.per_player, dict) else True
    with_crops = stats.withColumn("player_crops", F.create_map(F.lit("1"), F.lit("key")))
    assert list(serving.with_crop_urls(with_crops, "http://x/").first()["crop_urls"]) == ["1"]
    assert a.crosstab().agg(F.sum("n")).first()[0] <= a.shots.count()
    ordered = a.rallies.orderBy("match_id", "start_frame").collect()
    assert all(y.start_frame - x.end_frame > DEFAULT.rally_gap for x, y in zip(ordered, ordered[1:], strict=False) if x.match_id == y.match_id)


def test_a_match_without_a_homography_has_no_places(spark):
    b = adapters.ball_raw(two_matches(spark))
    p = adapters.players(b)
    known = spark.createDataFrame([(0, [list(r) for r in H])], "match_id long, homography array<array<double>>")
    stats = {r.match_id: r for r in stats_document(analyse(b, p, known, adapters.poses(p), share=True)).collect()}
    assert {len(v) for v in stats[1].heatmaps.values()} == {0} and {v.distance_m for v in stats[1].per_player.values()} == {0.0}
    plain = {r.match_id: r for r in stats_document(analyse(b, p, adapters.homography(), adapters.poses(p))).collect()}
    assert stats[0].per_player == plain[0].per_player and stats[0].heatmaps == plain[0].heatmaps and stats[0].rallies == plain[0].rallies


def test_crop_urls_without_crops(spark):
    stats = spark.createDataFrame([("m", None)], "match_id string, player_crops map<string,string>")
    assert serving.with_crop_urls(stats, "http://x").first()["crop_urls"] == {}


def test_display_names(spark):
    matches = spark.createDataFrame([("a", ["Ann", ""]), ("b", None)], "id string, player_names array<string>")
    got = {(r.id, r.player_id): r.name for r in serving.display_names(matches).collect()}
    assert got[("a", 0)] == "Ann" and got[("a", 1)] == "P2" and got[("b", 3)] == "P4"
    assert rows(serving.any_name(matches)) == [("a", True), ("b", False)]


def test_decoder_plugin(spark, tmp_path):
    class Bytes:
        def frames(self, path):
            for i, value in enumerate(urllib.request.urlopen(path).read()):
                yield {"match_id": 1, "frame_idx": i, "value": value}

    (tmp_path / "v.bin").write_bytes(bytes(range(100)))
    frames = media.decode(media.videos(spark, str(tmp_path)), Bytes(), "match_id long, frame_idx long, value int")
    assert frames.count() == 100 and frames.where("frame_idx <> value").count() == 0


class Counting:
    """A plug-in whose rows tell how many frames of the match it has seen."""

    def __init__(self, make):
        self.make = make

    def begin(self, match_id):
        make, seen = self.make, [0]

        class Session:
            def step(self, frames):
                import pandas as pd

                assert frames["frame_idx"].is_monotonic_increasing and frames["match_id"].nunique() == 1
                out = []
                for frame in frames.itertuples():
                    seen[0] += 1
                    out += make(frame, seen[0])
                return pd.DataFrame(out)

        return Session()


def test_plugins_keep_their_state_over_batches(spark):
    frames = spark.range(300).selectExpr("id % 3 as match_id", "id div 3 as frame_idx")
    ball = Counting(lambda f, n: [{"match_id": f.match_id, "frame_idx": f.frame_idx, "x_px": float(n), "y_px": 0.0, "confidence": 1.0}])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = media.detect_ball(frames, ball).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.match_id, r.frame_idx, r.x_px) for r in got) == [(m, f, f + 1.0) for m in range(3) for f in range(100)]


def test_court_detectors_in_turn_and_crops(spark):
    frames = spark.range(40).selectExpr("id % 4 as match_id", "id div 4 as frame_idx")
    samples = detection.sample_frames(spark.createDataFrame([(m, 1.0, 10) for m in range(4)], "match_id long, fps double, n_frames long")).where("sample % 10 = 0")
    where = ((281.0, 72.0), (999.0, 72.0), (1204.0, 669.0), (76.0, 669.0))
    corners = lambda f, shift: [{"match_id": f.match_id, "sample": f.sample, "idx": i, "x": x + shift, "y": y, "estimated": False} for i, (x, y) in enumerate(where)]
    by_lines = Counting(lambda f, n: corners(f, 0.0) if f.match_id == 0 else [])
    by_colour = Counting(lambda f, n: corners(f, 10.0) if f.match_id < 2 else [])
    found = media.detect_courts(frames, samples, by_lines, by_colour)
    videos = spark.createDataFrame([(m, 1280, 720) for m in range(3)], "match_id long, width int, height int")
    got = {r.match_id: r for r in detection.calibrations(found, videos).collect()}
    assert [got[m].estimated for m in range(3)] == [False, False, True]
    for have, want in zip(sum(got[0].homography, []), sum(g.fit_homography(where), []), strict=True):
        assert have == pytest.approx(want, abs=1e-9)
    assert got[2].homography == got[0].homography != got[1].homography
    boxes = spark.createDataFrame([(0, 1, 4, 0, 0, 5, 5)], "match_id long, player_id int, frame_idx long, left int, top int, right int, bottom int")
    crops = media.encode_crops(frames, boxes, Counting(lambda f, n: [{"match_id": f.match_id, "player_id": f.player_id, "image": bytes([f.right])}])).collect()
    assert [(r.match_id, r.player_id, bytes(r.image)) for r in crops] == [(0, 1, b"\x05")]


def test_corners_on_a_line_give_no_homography(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1)], "x double")
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    assert df.select(g.homography_of_corners(at(0.0, 0.0), at(1.0, 0.0), at(2.0, 0.0), at(3.0, 0.0)).alias("h")).first()["h"] is None


def test_streaming_rallies(spark, tmp_path):
    from rallyframe.streaming.rallies import stream_rallies

    for i, frames in enumerate(([0, 60], [121, 125], [2000])):
        events(spark, *[(f, "hit", 1) for f in frames]).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = stream_rallies(stream).writeStream.format("memory").queryName("rally_stream").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = rows(spark.table("rally_stream"), "start_frame", "end_frame", "n_events", "last_track")
    assert got == [(0, 60, 2, 1), (121, 125, 2, 1)]


def test_places_in_a_match_are_counted_by_stretches(spark):
    from rallyframe.operators.ordered import numbered

    got = numbered(spark.range(500).selectExpr("id % 2 as m", "nullif(id div 40, 3) as s", "id * 7 % 500 as v"), ["m"], F.col("s"), ["v"], "t")
    want = {}
    for i in range(500):
        want.setdefault(i % 2, []).append((-1 if i // 40 == 3 else i // 40, i * 7 % 500))
    assert sorted((r.m, r.t, r.v) for r in got.collect()) == sorted((m, t, v) for m, rs in want.items() for t, (_, v) in enumerate(sorted(rs)))
    ball = adapters.ball_raw(two_matches(spark))
    windows = lambda df: [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert len(windows(adapters.players(ball))) == len(windows(ball)) == 2  # of an hour's rows, and of one row an hour


def test_only_events_of_frames_without_players_look_around(spark):
    players = player_rows(spark, (10, 1, 0, 9, 0), (11, 2, 0, 0, 0), (20, 3, 0, 0, 0))
    peaks = spark.createDataFrame([(0, f, 0.0, 0.0, 0.0, 0.0) for f in (10, 12, 15, 40)], "match_id long, frame_idx long, x double, y double, cx double, cy double")
    found = joins.nearest_player(peaks, players, F.abs("r_foot_x_m"))
    assert rows(found, "frame_idx", "r_track_id", "dist") == [(10, 1, 9.0), (12, 2, 0.0), (15, 2, 0.0)]
    assert "LeftAnti" in found._jdf.queryExecution().optimizedPlan().toString()
