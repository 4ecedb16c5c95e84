"""Masks of frames as runs: a row for each stretch of set pixels in a line of a frame (y, x0, x1, both ends included).

A run-length mask is some hundredth of its pixels, and every operation here is a window over one line of one frame or a
join of neighbouring lines, so frames of any number are worked on together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: An element: its lines as (dy, first dx, last dx).
Element = tuple[tuple[int, int, int], ...]
FRAME = ["match_id", "frame_idx"]
LINE = [*FRAME, "y"]
#: Ellipses of 2 and of 5 pixels.
SMALL_ELLIPSE: Element = ((-1, 0, 0), (0, -1, 0))
ELLIPSE: Element = ((-2, 0, 0), (-1, -2, 2), (0, -2, 2), (1, -2, 2), (2, 0, 0))


def rectangle(width: int, height: int) -> Element:
    """Centred; the middle of an even size is after its centre."""
    return tuple((dy - height // 2, -(width // 2), width - 1 - width // 2) for dy in range(height))


def mask_runs(cells: DataFrame) -> DataFrame:
    """match_id, frame_idx, y, x0, x1 from set cells (match_id, frame_idx, y, x), repeated ones too."""
    w = Window.partitionBy(*LINE).orderBy("x")
    island = cells.select(*LINE, "x").distinct().withColumn("island", F.col("x") - F.row_number().over(w))
    return island.groupBy(*LINE, "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def _covered(spread: DataFrame, least: int) -> DataFrame:
    """Where at least so many of the stretches (match_id, frame_idx, y, x0, x1) of a line lie over each other."""
    ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("step")), F.struct((F.col("x1") + 1).alias("x"), F.lit(-1).alias("step"))))
    steps = spread.where("x0 <= x1").select(*LINE, ends.alias("e")).groupBy(*LINE, F.col("e.x").alias("x")).agg(F.sum("e.step").alias("step"))
    w = Window.partitionBy(*LINE).orderBy("x")
    depth = steps.withColumn("depth", F.sum("step").over(w)).withColumn("deep", F.col("depth") >= least)
    turns = depth.withColumn("was", F.coalesce(F.lag("deep").over(w), F.lit(False))).where("deep <> was")
    return turns.withColumn("x1", F.lead("x").over(w) - 1).where("deep").select(*LINE, F.col("x").alias("x0"), "x1")


def dilate(runs: DataFrame, element: Element) -> DataFrame:
    """Pixels that the element covers when it stands on any set pixel."""
    lines = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x0") + a).alias("x0"), (F.col("x1") + b).alias("x1")) for dy, a, b in element]))
    return _covered(runs.select(*FRAME, lines.alias("s")).select(*FRAME, "s.*"), 1)


def erode(runs: DataFrame, element: Element) -> DataFrame:
    """Pixels where the whole element stands on set pixels; beyond the frame nothing is set."""
    lines = F.explode(F.array(*[F.struct((F.col("y") - dy).alias("y"), (F.col("x0") - a).alias("x0"), (F.col("x1") - b).alias("x1")) for dy, a, b in element]))
    return _covered(runs.select(*FRAME, lines.alias("s")).select(*FRAME, "s.*"), len(element))


def opened(runs: DataFrame, element: Element) -> DataFrame:
    return dilate(erode(runs, element), element)


def closed(runs: DataFrame, element: Element) -> DataFrame:
    return erode(dilate(runs, element), element)


def _labels(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """For each run, which come by line and place, the first run of its component; corners touch. Disjoint sets."""
    root = np.arange(len(y))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    begins = np.searchsorted(y, np.unique(y))
    ends = np.append(begins[1:], len(y))
    for (a, b), (c, d) in zip(zip(begins, ends, strict=True), zip(begins[1:], ends[1:], strict=True), strict=False):
        if y[c] != y[a] + 1:
            continue
        i, j = a, c
        while i < b and j < d:
            if x0[i] <= x1[j] + 1 and x0[j] <= x1[i] + 1:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
            if x1[i] < x1[j]:
                i += 1
            else:
                j += 1
    return np.array([find(i) for i in range(len(y))], dtype=np.int64)


#: Steps around a pixel, clockwise from the left (y down).
_AROUND = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))


def outline(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> list[tuple[int, int]]:
    """The outer border of a component as pixels (x, y) in turn, from its first run's first pixel."""
    lines: dict[int, list[tuple[int, int]]] = {}
    for line, a, b in zip(y.tolist(), x0.tolist(), x1.tolist(), strict=True):
        lines.setdefault(line, []).append((a, b))
    inside = lambda px, py: any(a <= px <= b for a, b in lines.get(py, ()))
    at = begin = (int(x0[0]), int(y[0]))
    came, first, out = 0, None, []  # the pixel to the left of the first is not set
    while True:
        for turn in range(1, 9):
            d = (came + turn) % 8
            to = (at[0] + _AROUND[d][0], at[1] + _AROUND[d][1])
            if inside(*to):
                break
        else:
            return [begin]
        if at == begin and first == d:
            return out
        first = d if first is None else first
        out.append(at)
        at, came = to, (d + 4) % 8


def _measures(points: list[tuple[int, int]]) -> tuple[float, float, float, float]:
    """Area, length and centroid of the polygon through the points; the first point for one without area."""
    p = np.array(points, dtype=float)
    q = np.roll(p, -1, axis=0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    area, length = cross.sum() / 2, float(np.hypot(*(q - p).T).sum())
    if abs(area) < 1e-9:
        return 0.0, length, float(p[0, 0]), float(p[0, 1])
    cx, cy = (((p + q) * cross[:, None]).sum(axis=0) / (6 * area)).tolist()
    return abs(float(area)), length, cx, cy


def components(runs: DataFrame, outlines: bool = False) -> DataFrame:
    """A row a component of set pixels that touch, corners included.

    match_id, frame_idx, component (0, 1, ... by the first pixel in reading order), n_pixels, left, top, right, bottom;
    and of the polygon through the pixels of its outer border: area, perimeter, x, y. With `outlines`, its points too. The
    runs of a frame, which its size bounds, are one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, frame in zip(zip(*(batch.column(c).to_pylist() for c in FRAME), strict=True), batch.column("runs"), strict=True):
                y, x0, x1 = (frame.values.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x0", "x1"))
                label = _labels(y, x0, x1)
                for n, first in enumerate(np.unique(label)):
                    own = label == first
                    points = outline(y[own], x0[own], x1[own])
                    box = int(x0[own].min()), int(y[own].min()), int(x1[own].max()), int(y[own].max())
                    rows.append((*key, n, int((x1[own] - x0[own] + 1).sum()), *box, *_measures(points), [{"x": a, "y": b} for a, b in points] if outlines else None))
            if rows:
                point = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))
                kinds = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 5 + [pa.float64()] * 4 + [point]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = [*FRAME, "component", "n_pixels", "left", "top", "right", "bottom", "area", "perimeter", "x", "y", "points"]
    kind = (
        "match_id long, frame_idx long, component int, n_pixels long, left long, top long, right long, bottom long, "
        "area double, perimeter double, x double, y double, points array<struct<x:long,y:long>>"
    )
    whole = [F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")]
    packed = runs.groupBy(*[F.col(c).cast("long").alias(c) for c in FRAME]).agg(F.array_sort(F.collect_list(F.struct(*whole))).alias("runs"))
    out = packed.mapInArrow(run, kind)
    return out if outlines else out.drop("points")


def candidates(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Components as ball candidates: match_id, frame_idx, seq, area, perimeter, brightness (0 to 1 over the box), x, y.

    lines: match_id, frame_idx, y, pixels (binary, a byte a pixel of the line).
    """
    spread = found.select(*FRAME, "component", "left", "right", F.explode(F.sequence("top", "bottom")).alias("y"))
    cut = spread.join(lines, LINE).select(*FRAME, "component", F.expr("substring(pixels, cast(`left` + 1 as int), cast(`right` - `left` + 1 as int))").alias("part"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(p, np.uint8) for p in batch.column("part").to_pylist()]
            sums = pa.array([int(p.sum()) for p in parts], pa.int64()), pa.array([len(p) for p in parts], pa.int64())
            yield pa.record_batch([*(batch.column(c) for c in (*FRAME, "component")), *sums], names=[*FRAME, "component", "light", "n"])

    summed = cut.mapInArrow(total, "match_id long, frame_idx long, component int, light long, n long")
    mean = summed.groupBy(*FRAME, "component").agg((F.sum("light") / F.sum("n") / 255).alias("brightness"))
    return found.join(mean, [*FRAME, "component"]).select(*FRAME, F.col("component").alias("seq"), "area", "perimeter", "brightness", "x", "y")
