"""Encoded frames of video files as a Spark data source.

A file is cut into ranges of bytes, as other splittable formats are, without being opened on the driver. A task reads the
index of its file and takes the groups of frames whose key frame lies in its range, so each group is read once and
decoding can begin in any task. Small ranges are dealt to tasks many at a time, neighbours of one file as one range. A range of frames, a stride, key frames only and the wanted columns are options of the
read: only the bytes of frames that meet them are read, and without the column `data` no frame is. They are options and
not pushed conditions, because Spark keeps what it has pushed into a Python source for later uses of the same DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .containers import Read, SampleIndex, sample_index

NAME = "video_frames"
#: Bytes of a range; a task has at least one group of frames.
SPLIT_BYTES = 64 << 20
#: Bytes read at once, and the largest gap (sound between frames) that is read over.
READ_BYTES, GAP_BYTES = 8 << 20, 64 << 10
#: Rows of a batch.
ROWS = 256
SCHEMA = "path string, sample long, frame_idx long, group long, seconds double, key boolean, codec string, width int, height int, position long, size long, data binary"


#: What opening a file counts, in bytes, when ranges are dealt to tasks, and the ranges that a slot of the cluster gets.
OPEN_BYTES, TASKS_A_SLOT = 64 << 10, 4


@dataclass
class ByteRange:
    path: str
    size: int
    first: int
    end: int


@dataclass
class ByteRanges(InputPartition):
    ranges: list[ByteRange]


def dealt(ranges: list[ByteRange], least: int, slots: int) -> list[ByteRanges]:
    """The ranges, which come by file and place, in order to tasks: as many as the slots can use, or as SPLIT_BYTES asks for."""
    opened = len({r.path for r in ranges})
    goal = max(least, min(SPLIT_BYTES, -(-(sum(r.end - r.first for r in ranges) + OPEN_BYTES * opened) // (TASKS_A_SLOT * slots))))
    out: list[ByteRanges] = []
    left = 0
    for r in ranges:
        last = out[-1].ranges[-1] if out else None
        same = last is not None and last.path == r.path
        cost = r.end - r.first + (0 if same else OPEN_BYTES)
        if not out or cost > left:
            out.append(ByteRanges([ByteRange(r.path, r.size, r.first, r.end)]))
            left = goal - (r.end - r.first)
        elif same:
            last.end, left = r.end, left - cost
        else:
            out[-1].ranges.append(ByteRange(r.path, r.size, r.first, r.end))
            left -= cost
    return out


def listed(path: str) -> list[tuple[str, int]]:
    """Path and bytes of the file, or of all files below a folder, in any file system that Arrow opens."""
    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(root)
    if found.type == fs.FileType.File:
        return [(path, found.size)]
    base = path[: len(path) - len(root)] if path.endswith(root) else path.rstrip("/")[: len(path.rstrip("/")) - len(root)]
    inside = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((base + f.path, f.size) for f in inside if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


class FrameReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.path = schema.names, options["path"]
        self.split, self.stride = int(options.get("splitbytes", SPLIT_BYTES)), int(options.get("stride", 1))
        self.slots = int(options.get("slots", 1))
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", (1 << 63) - 1))
        self.keys_only = options.get("keysonly", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        ranges = [ByteRange(path, size, a, min(a + self.split, size)) for path, size in listed(self.path) for a in range(0, size, self.split)]
        return dealt(ranges, self.split, self.slots)

    def read(self, partition: ByteRanges | None) -> Iterator[pa.RecordBatch]:
        for part in partition.ranges if partition is not None else ():  # None: no files
            store, place = fs.FileSystem.from_uri(part.path)
            with store.open_input_file(place) as file:
                yield from self.rows(part, lambda at, n, file=file: file.read_at(n, at))

    def rows(self, part: ByteRange, read: Read) -> Iterator[pa.RecordBatch]:
        """The batches of a range, by a function that reads its file."""
        index = sample_index(read, part.size)
        wanted = self._wanted(index, part)
        frames, groups = index.frames, index.groups
        for own, data in self._batches(index, wanted, read):
            n = len(own)
            columns = {
                "path": lambda: pa.array([part.path] * n),
                "sample": lambda: pa.array(own, pa.int64()),
                "frame_idx": lambda: pa.array(frames[own], pa.int64()),
                "group": lambda: pa.array(groups[own], pa.int64()),
                "seconds": lambda: pa.array(index.seconds[own]),
                "key": lambda: pa.array(index.keys[own]),
                "codec": lambda: pa.array([index.codec] * n),
                "width": lambda: pa.array([index.width] * n, pa.int32()),
                "height": lambda: pa.array([index.height] * n, pa.int32()),
                "position": lambda: pa.array(index.offsets[own], pa.int64()),
                "size": lambda: pa.array(index.sizes[own], pa.int64()),
                "data": lambda: pa.array(data, pa.binary()),
            }
            yield pa.record_batch([columns[c]() for c in self.names], names=self.names)

    def _wanted(self, index: SampleIndex, part: ByteRange) -> np.ndarray:
        """Samples of the groups that begin in the range, without those that the options leave out."""
        frames, starts = index.frames, index.offsets[index.groups]
        own = (starts >= part.first) & (starts < part.end) & (frames >= self.first) & (frames <= self.last) & (frames % self.stride == 0)
        return np.flatnonzero(own & index.keys if self.keys_only else own)

    def _batches(self, index: SampleIndex, wanted: np.ndarray, read: Read) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """Up to ROWS samples at a time and their bytes: neighbours by one read of at most READ_BYTES or one sample."""
        if "data" not in self.names:
            for at in range(0, len(wanted), ROWS):
                yield wanted[at : at + ROWS], []
            return
        at = 0
        while at < len(wanted):
            first, to = index.offsets[wanted[at]], at + 1
            end = first + index.sizes[wanted[at]]
            while to < len(wanted) and to - at < ROWS:
                place, size = index.offsets[wanted[to]], index.sizes[wanted[to]]
                if not end <= place <= end + GAP_BYTES or place + size - first > READ_BYTES:
                    break
                end, to = place + size, to + 1
            whole = read(int(first), int(end - first))
            own = wanted[at:to]
            yield own, [whole[a : a + n] for a, n in zip((index.offsets[own] - first).tolist(), index.sizes[own].tolist(), strict=True)]
            at = to


class FrameSource(DataSource):
    """Options: path; splitBytes; slots (tasks that run at once); first and last (frame_idx, both included); stride (of frame_idx); keysOnly."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(schema, self.options)


def read_frames(
    spark: SparkSession,
    path: str,
    columns: tuple[str, ...] | None = None,
    first: int = 0,
    last: int | None = None,
    stride: int = 1,
    keys_only: bool = False,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """The frames from `first` to `last` of a file or of all files below a folder; with `columns`, nothing else is read."""
    spark.dataSource.register(FrameSource)
    reader = spark.read.format(NAME).options(first=first, stride=stride, keysOnly=keys_only, splitBytes=split_bytes, slots=spark.sparkContext.defaultParallelism)
    if last is not None:
        reader = reader.option("last", last)
    if columns is not None:
        kinds = dict(c.split() for c in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"`{c}` {kinds[c]}" for c in columns))
    return reader.load(path)
