"""Rally outcomes, winners, errors, and shot counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, SHOT_TYPES, Thresholds
from ..functions.geometry import near_edge
from .joins import interval_join
from .players import player_slots


def rally_players(rallies: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rallies with last_player, null where the last hitter is no canonical player."""
    names = mapping.select("match_id", F.col("track_id").alias("last_track"), F.col("player_id").alias("last_player"))
    return rallies.join(names, ["match_id", "last_track"], "left")


def rally_outcomes(rallies: DataFrame, ball_m: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """match_id, rally_idx, outcome: error if the last position around the end is near an edge, else winner, or unknown.

    ball_m: match_id, frame_idx, cx, cy of visible rows.
    """
    return with_outcomes(rallies.select("match_id", "rally_idx", "end_frame"), ball_m, t).select("match_id", "rally_idx", "outcome")


def with_outcomes(rallies: DataFrame, ball_m: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """All columns of the rallies, and outcome."""
    tail = interval_join(rallies, ball_m.select("match_id", "frame_idx", "cx", "cy"), t.rally_tail, t.rally_ahead, "left", frame="end_frame")
    last = tail.groupBy(*rallies.columns).agg(F.max_by(F.struct("r_cx", "r_cy"), "r_frame_idx").alias("p"))
    edge = near_edge(F.col("p.r_cx"), F.col("p.r_cy"), t.boundary_margin_m, t)
    return last.select(*rallies.columns, F.when(F.col("p").isNull(), "unknown").when(edge, "error").otherwise("winner").alias("outcome"))


def winners_errors(outcomes: DataFrame, rallies: DataFrame, mapping: DataFrame) -> DataFrame:
    """match_id, player_id, winners, errors of all four players; rallies without a canonical last hitter count to none."""
    return dense_results(rally_players(rallies, mapping).join(outcomes, ["match_id", "rally_idx"]), mapping)


def dense_results(who: DataFrame, mapping: DataFrame) -> DataFrame:
    """winners_errors of rallies that have last_player and outcome."""
    ended = lambda how: F.count_if(F.col("outcome") == how)
    mine = who.where("last_player is not null").groupBy("match_id", F.col("last_player").alias("player_id"))
    counts = mine.agg(ended("winner").alias("winners"), ended("error").alias("errors"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return player_slots(mapping).join(counts, ["match_id", "player_id"], "left").select("match_id", "player_id", zero("winners"), zero("errors"))


def shot_players(shots: DataFrame, mapping: DataFrame) -> DataFrame:
    """Shots of canonical players, with player_id."""
    return shots.join(mapping.select("match_id", "track_id", "player_id"), ["match_id", "track_id"])


def shot_crosstab(shots: DataFrame, mapping: DataFrame) -> DataFrame:
    """match_id, player_id, shot_type, n: every player and type, zeros included."""
    counts = shot_players(shots, mapping).groupBy("match_id", "player_id", "shot_type").agg(F.count(F.lit(1)).alias("n"))
    dense = player_slots(mapping).withColumn("shot_type", F.explode(F.array(*[F.lit(s) for s in SHOT_TYPES])))
    return dense.join(counts, ["match_id", "player_id", "shot_type"], "left").select("match_id", "player_id", "shot_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
