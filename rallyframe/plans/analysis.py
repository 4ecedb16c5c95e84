"""The whole analysis over any number of matches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, SHOT_TYPES, Thresholds
from ..functions.geometry import homography_columns, to_court
from ..operators import events as ev
from ..operators import joins, kinematics, outcomes, shots
from ..operators import players as pl
from ..operators.smoothing import kalman_smooth
from ..storage import stored


class Analysis:
    """Every intermediate table, planned when it is asked for.

    A table that several others read is written once to the shared folder when `share` is set, so that each of them
    scans it instead of computing it from the tracks again.
    """

    def __init__(
        self,
        ball: DataFrame,
        players: DataFrame,
        homography: Sequence[Column] | DataFrame,
        poses: DataFrame | None = None,
        fps: float = 30.0,
        smooth: bool = False,
        t: Thresholds = DEFAULT,
        share: bool = False,
    ) -> None:
        """homography: the nine entries for all matches, or a table of match_id and homography."""
        self._ball, self._players, self._homography, self._poses = ball, players, homography, poses
        self.fps, self.smooth, self.thresholds, self.share = fps, smooth, t, share

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name) if self.share else df

    @cached_property
    def players(self) -> DataFrame:
        if isinstance(self._homography, DataFrame):
            return self._kept(calibrated_players(self._players, self._homography), "players")
        return self._kept(self._players, "players")

    @cached_property
    def steps(self) -> DataFrame:
        t = self.thresholds
        ball = kalman_smooth(self._ball, t.max_gap, t) if self.smooth else self._ball
        if not isinstance(self._homography, DataFrame):
            return self._kept(kinematics.differences(ball, self._homography, t), "steps")
        return self._kept(kinematics.differences(with_homography(ball, self._homography), homography_columns("homography"), t), "steps")

    @cached_property
    def events(self) -> DataFrame:
        found = joins.detected_events(self.steps, self.players, self.fps, True, self.thresholds)
        return self._kept(ev.dedup_events(found, self.thresholds), "events")

    @cached_property
    def mapping(self) -> DataFrame:
        return self._kept(pl.player_map(self.players, self.thresholds), "mapping")

    @cached_property
    def tracked(self) -> DataFrame:
        return pl.mapped(self.players, self.mapping)

    @cached_property
    def rallies(self) -> DataFrame:
        """match_id, rally_idx, start_frame, end_frame, last_track, last_player."""
        return self._kept(outcomes.rally_players(ev.rallies(self.events, self.thresholds), self.mapping), "rallies")

    @cached_property
    def outcomes(self) -> DataFrame:
        """The rallies with their outcome."""
        return outcomes.with_outcomes(self.rallies, self.steps, self.thresholds)

    @cached_property
    def features(self) -> DataFrame:
        hits = self.events.where("type = 'hit'")
        matched = None
        if self._poses is not None:
            here = self._poses.join(hits.select("match_id", "frame_idx"), ["match_id", "frame_idx"], "left_semi")
            matched = joins.match_poses(here, self.players, self.thresholds).join(here, ["match_id", "frame_idx", "pose_seq"])
        return shots.shot_features(hits, self.players, self.steps, matched, self.fps, self.thresholds)

    @cached_property
    def shots(self) -> DataFrame:
        return shots.classify(self.features, True, self.thresholds)

    def distances(self) -> DataFrame:
        found = pl.distances(self.tracked, self.thresholds)
        return pl.player_slots(self.mapping).join(found, ["match_id", "player_id"], "left").withColumn("distance_m", F.coalesce("distance_m", F.lit(0.0)))

    def crosstab(self) -> DataFrame:
        return outcomes.shot_crosstab(self.shots, self.mapping)

    def winners_errors(self) -> DataFrame:
        return outcomes.dense_results(self.outcomes, self.mapping)

    def heatmap(self) -> DataFrame:
        return pl.heatmap(self.tracked, self.thresholds)


analyse = Analysis


def with_homography(rows: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Rows with their match's homography; a match without one has nulls, so nothing of it has a place on the court."""
    return rows.join(calibrations.select("match_id", "homography"), "match_id", "left")


def calibrated_players(players: DataFrame, calibrations: DataFrame) -> DataFrame:
    """The players' metres anew from their pixels."""
    x, y = to_court(F.col("foot_x_px"), F.col("foot_y_px"), homography_columns("homography"))
    return with_homography(players, calibrations).withColumns({"foot_x_m": x, "foot_y_m": y}).select(*players.columns)


def _by_key(keys: list[str], values: list[Column]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*values))


def stats_document(a: Analysis) -> DataFrame:
    """match_id, per_player, heatmaps, rallies: one nested row a match, dense over four players and all shot types.

    Tracks, rallies and shots are read once each and summed to a row a match.
    """
    slots = range(a.thresholds.players)
    moved = pl.path_sums(a.tracked, a.thresholds)
    of = lambda p, c: F.max(F.when(F.col("player_id") == p, F.col(c)))
    moved = moved.groupBy("match_id").agg(*[of(p, c).alias(f"{c}{p}") for p in slots for c in ("distance_m", "points")])

    ended = lambda p, how: F.count_if((F.col("last_player") == p) & (F.col("outcome") == how))
    listed = F.array_sort(F.collect_list(F.struct("start_frame", "end_frame", F.col("last_player").cast("int").alias("last_player"))))
    ends = a.outcomes.groupBy("match_id").agg(listed.alias("rallies"), *[ended(p, how).alias(f"{how}{p}") for p in slots for how in ("winner", "error")])

    made = lambda p, kind: F.count_if((F.col("player_id") == p) & (F.col("shot_type") == kind))
    hits = outcomes.shot_players(a.shots, a.mapping).groupBy("match_id").agg(*[made(p, kind).alias(f"{kind}{p}") for p in slots for kind in SHOT_TYPES])

    wide = a.mapping.select("match_id").distinct().join(moved, "match_id", "left").join(ends, "match_id", "left").join(hits, "match_id", "left")
    keys = [str(p) for p in slots]
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")

    def player(p: int) -> Column:
        kinds = F.map_from_arrays(F.array(*[F.lit(k) for k in SHOT_TYPES]), F.array(*[count(f"{k}{p}") for k in SHOT_TYPES]))
        return F.struct(F.coalesce(f"distance_m{p}", F.lit(0.0)).alias("distance_m"), count(f"winner{p}").alias("winners"), count(f"error{p}").alias("errors"), kinds.alias("shots"))

    points = [F.coalesce(F.col(f"points{p}"), F.array().cast("array<array<double>>")) for p in slots]
    none = F.array().cast("array<struct<start_frame:bigint,end_frame:bigint,last_player:int>>")
    return wide.select("match_id", _by_key(keys, [player(p) for p in slots]).alias("per_player"), _by_key(keys, points).alias("heatmaps"), F.coalesce("rallies", none).alias("rallies"))


def with_media(documents: DataFrame, calibrations: DataFrame, crops: DataFrame) -> DataFrame:
    """The documents with court_calibration (homography, estimated) and player_crops (player to the key of its picture).

    calibrations: match_id, homography, estimated; crops: match_id, player_id, key. Null where a match has none.
    """
    courts = calibrations.select("match_id", F.struct("homography", "estimated").alias("court_calibration"))
    entry = F.struct(F.col("player_id").cast("string").alias("k"), F.col("key").alias("v"))
    pictures = crops.groupBy("match_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("player_crops"))
    return documents.join(courts, "match_id", "left").join(pictures, "match_id", "left")
