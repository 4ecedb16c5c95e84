"""Views over stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(matches: DataFrame, limit: int = 50) -> DataFrame:
    """Newest first; the id decides among equals."""
    return matches.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def lookup(matches: DataFrame, match_id: str) -> DataFrame:
    return matches.where(F.col("id") == match_id)


def with_stats(matches: DataFrame, stats: DataFrame) -> DataFrame:
    """Matches with their statistics, null until ready."""
    return matches.join(stats, matches["id"] == stats["match_id"], "left")


def total_shots() -> Column:
    """Over all players and types of a per_player map."""
    each = F.transform(F.map_values("per_player"), lambda p: F.aggregate(F.map_values(p["shots"]), F.lit(0).cast("long"), lambda a, n: a + n))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, n: a + n)


def stats_read(stats: DataFrame) -> DataFrame:
    """match_id, per_player, heatmaps, rallies_count, total_shots."""
    return stats.select("match_id", "per_player", "heatmaps", F.size("rallies").alias("rallies_count"), total_shots().alias("total_shots"))


def with_crop_urls(stats: DataFrame, base_url: str) -> DataFrame:
    """crop_urls: for each player that has a crop, its address; no key for the others."""
    url = lambda k, _: F.concat(F.lit(base_url.rstrip("/") + "/matches/"), F.col("match_id").cast("string"), F.lit("/crops/"), k)
    return stats.withColumn("crop_urls", F.transform_values(F.coalesce("player_crops", F.create_map().cast("map<string,string>")), url))


def by_player_number(column: str, type_of_value: str) -> Column:
    """Entries of a map with numeric text keys as an array of (n, value), in numeric order."""
    entries = F.transform(F.map_entries(column), lambda e: F.struct(e["key"].cast("int").alias("n"), e["value"].cast(type_of_value).alias("value")))
    return F.array_sort(entries, lambda a, b: a["n"] - b["n"])


def shot_shares(crosstab: DataFrame) -> DataFrame:
    """match_id, player_id, shot_type, n, share of the player's shots; 0 without any."""
    total = crosstab.groupBy("match_id", "player_id").agg(F.sum("n").alias("total"))
    return crosstab.join(total, ["match_id", "player_id"]).select("match_id", "player_id", "shot_type", "n", (F.col("n") / F.greatest("total", F.lit(1))).alias("share"))


def shot_pivot(crosstab: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """A column a shot type and their total."""
    wide = crosstab.groupBy("match_id", "player_id").pivot("shot_type", list(types)).agg(F.first("n"))
    return wide.withColumn("total", sum((F.col(t) for t in types[1:]), F.col(types[0])))


def summary_cards(stats: DataFrame) -> DataFrame:
    """match_id, total_winners, mean_distance, total_shots, rallies_count, mean_rally_frames of result documents."""
    players = F.map_values("per_player")
    total = lambda values, kind: F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)
    moved = total(F.transform(players, lambda p: p["distance_m"]), "double") / F.greatest(F.size(players), F.lit(1))
    frames = total(F.transform("rallies", lambda r: r["end_frame"] - r["start_frame"]), "long")
    return stats.select(
        "match_id",
        F.round(moved).cast("long").alias("mean_distance"),
        total(F.transform(players, lambda p: p["winners"]), "long").alias("total_winners"),
        total_shots().alias("total_shots"),
        F.size("rallies").cast("long").alias("rallies_count"),
        F.round(F.try_divide(frames, F.size("rallies")), 6).alias("mean_rally_frames"),
    )


def heat_marks(heatmap: DataFrame) -> DataFrame:
    """Radius and opacity of each cell's mark."""
    return heatmap.select("*", (F.sqrt("weight") * 30).alias("radius"), F.least(F.col("weight") * 12, F.lit(0.9)).alias("opacity"))


def display_names(matches: DataFrame, slots: int = 4) -> DataFrame:
    """id, player_id, name: the given name or P1, P2 ...; an empty one counts as missing."""
    rows = matches.select("id", "player_names", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("player_id"))
    given = F.get("player_names", F.col("player_id"))
    return rows.select("id", "player_id", F.coalesce(F.when(given != "", given), F.concat(F.lit("P"), (F.col("player_id") + 1).cast("string"))).alias("name"))


def any_name(matches: DataFrame) -> DataFrame:
    return matches.select("id", F.coalesce(F.exists("player_names", lambda x: x != ""), F.lit(False)).alias("has_names"))


def to_document(stats: DataFrame) -> DataFrame:
    """match_id and the row as JSON, for dumps and the edge of a service."""
    return stats.select("match_id", F.to_json(F.struct(*[c for c in stats.columns if c != "match_id"])).alias("document"))
