"""Media sources and the boundary to perception.

Decoding and neural inference are plug-ins: any object with these methods, given to the functions below, which run it on
the executors. Everything after them is tables. Files are in any store that Spark's file systems reach.

`perceive` runs all plug-ins in one pass over a file, so a file is decoded once, decoded frames never leave their task,
and a file that cannot be worked on fails alone. The functions below it take frames that are a table already.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..storage import stored


class FrameDecoder(Protocol):
    def frames(self, path: str) -> Iterator[dict]:
        """Dictionaries with match_id, frame_idx and whatever the decoder's schema adds. The decoder reads the file."""


class MatchSession(Protocol):
    """What a plug-in keeps of one match: a tracker's or a background model's state."""

    def step(self, frames: pd.DataFrame) -> pd.DataFrame:
        """Rows for the next frames of the match, which come in order."""


class Plugin(Protocol):
    """A tracker, ball detector, pose estimator, court detector or crop encoder."""

    def begin(self, match_id: int) -> MatchSession:
        """Called at a match's first frame."""


#: What the kinds of plug-in return. A court detector returns the corners it finds in sampled frames.
CORNERS = "match_id long, sample long, idx int, x double, y double, estimated boolean"
CROPS = "match_id long, player_id int, image binary"


def videos(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length: one row a file, from any file system that Spark lists; contents aren't read."""
    return spark.read.format("binaryFile").load(path).drop("content")


def decode(files: DataFrame, decoder: FrameDecoder, schema: str) -> DataFrame:
    """One row a frame. A decoder opens the file itself, so a file of any size is read as a stream."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows: list[dict] = []
                for row in decoder.frames(path):
                    rows.append(row)
                    if len(rows) == 64:
                        yield pd.DataFrame(rows)[names]
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)[names]

    return files.select("path").mapInPandas(run, schema)


#: Frames that a plug-in gets at once.
FRAMES = 64
ERRORS = "path string, message string"
_MESSAGE = 1000


def perceive(files: DataFrame, decoder: FrameDecoder, plugins: dict[str, tuple[Plugin, str, int]]) -> dict[str, DataFrame]:
    """A table for each plug-in (name: the plug-in, its schema, the stride of its frames), and `errors`.

    A task decodes a file from its beginning and gives each plug-in its frames, FRAMES at a time; what they find is all
    that is kept, in one table in the shared folder. A file whose decoder or plug-in raises has its message (1,000
    characters at most) in `errors` and no rows elsewhere.
    """
    columns = {name: [f.split()[0] for f in schema.split(", ")] for name, (_, schema, _) in plugins.items()}

    def rows_of(path: str) -> Iterator[tuple[str, dict]]:
        sessions: dict[str, MatchSession] = {}
        waiting: dict[str, list[dict]] = {name: [] for name in plugins}

        def step(name: str) -> Iterator[tuple[str, dict]]:
            frames, waiting[name] = waiting[name], []
            found = sessions[name].step(pd.DataFrame(frames))
            for row in found[columns[name]].to_dict("records") if len(found) else ():
                yield name, row

        for frame in decoder.frames(path):
            for name, (plugin, _, stride) in plugins.items():
                if frame["frame_idx"] % stride:
                    continue
                if name not in sessions:
                    sessions[name] = plugin.begin(frame["match_id"])
                waiting[name].append(frame)
                if len(waiting[name]) == FRAMES:
                    yield from step(name)
        for name in plugins:
            if waiting[name]:
                yield from step(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                try:
                    found: list[tuple[str, dict]] = []
                    for one in rows_of(path):
                        found.append(one)
                        if len(found) == 4096:
                            yield _tagged(path, found, plugins)
                            found = []
                    yield _tagged(path, [*found, (None, None)], plugins)
                except Exception as error:  # noqa: BLE001  whatever a plug-in raises is the file's failure, told in its row
                    yield _tagged(path, [("errors", {"path": path, "message": f"{type(error).__name__}: {error}"[:_MESSAGE]})], plugins)

    kinds = ", ".join(f"`{name}` struct<{', '.join(':'.join(f.split()) for f in schema.split(', '))}>" for name, schema in [*((n, p[1]) for n, p in plugins.items()), ("errors", ERRORS)])
    one = files.select("path").repartition(min(10_000, max(1, files.count())))  # a file a task, up to so many tasks
    all_rows = stored(one.mapInPandas(run, f"path string, {kinds}"), "perceived")
    errors = all_rows.where("errors is not null").select("errors.*")
    whole = all_rows.join(errors.select(F.col("path").alias("failed")), F.col("path") == F.col("failed"), "left_anti")
    return {name: whole.where(F.col(name).isNotNull()).select(f"{name}.*") for name in plugins} | {"errors": errors}


def _tagged(path: str, found: list[tuple[str | None, dict | None]], plugins: dict) -> pd.DataFrame:
    """A column a kind of rows, of which each row has one."""
    return pd.DataFrame({"path": [path] * len(found)} | {name: [row if kind == name else None for kind, row in found] for name in [*plugins, "errors"]})


def per_match(frames: DataFrame, plugin: Plugin, schema: str) -> DataFrame:
    """A plug-in over each match in frame order. A batch of frames is in memory at a time, and the plug-in's state."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, session = None, None
        for batch in batches:
            for match_id, rows in batch.groupby("match_id", sort=False):  # sorted rows: runs of one match
                if session is None or match_id != now:
                    now, session = match_id, plugin.begin(match_id)
                found = session.step(rows)
                if len(found):
                    yield found[names]

    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frames.repartition(parts, "match_id").sortWithinPartitions("match_id", "frame_idx").mapInPandas(run, schema)


def strided(frames: DataFrame, stride: int) -> DataFrame:
    return frames.where(F.col("frame_idx") % stride == 0)


def detect_players(frames: DataFrame, tracker: Plugin, stride: int = 2) -> DataFrame:
    return per_match(strided(frames, stride), tracker, schemas.PLAYERS)


def detect_ball(frames: DataFrame, detector: Plugin) -> DataFrame:
    return per_match(frames, detector, schemas.BALL)


def estimate_poses(frames: DataFrame, targets: DataFrame, estimator: Plugin) -> DataFrame:
    """Only on target frames."""
    return per_match(frames.join(targets, ["match_id", "frame_idx"], "left_semi"), estimator, schemas.POSES)


def detect_courts(frames: DataFrame, samples: DataFrame, *detectors: Plugin) -> DataFrame:
    """Corners in sampled frames by the first detector that finds any in the match, e.g. by lines, then by colour.

    samples: match_id, sample, frame_idx. Matches without corners of any detector have no rows here; `calibrations`
    then estimates.
    """
    seen = frames.join(samples, ["match_id", "frame_idx"])
    found = stored(per_match(seen, detectors[0], CORNERS), "corners")
    for detector in detectors[1:]:
        open_ = seen.join(found.select("match_id").distinct(), "match_id", "left_anti")
        found = found.unionByName(stored(per_match(open_, detector, CORNERS), "corners"))
    return found


def encode_crops(frames: DataFrame, boxes: DataFrame, encoder: Plugin) -> DataFrame:
    """match_id, player_id, image. boxes: match_id, player_id, frame_idx, left, top, right, bottom."""
    return per_match(frames.join(boxes, ["match_id", "frame_idx"]), encoder, CROPS)
