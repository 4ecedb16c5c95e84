"""Courts from masks: straight lines by votes, and corners from the outline of the largest component."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .masks import FRAME, components

#: Tolerances of the outline's corners as shares of its length, the coarser the later.
TOLERANCES = (0.01, 0.02, 0.03, 0.05, 0.08, 0.12)
#: Least shares of the frame that a court by lines covers: for four corners, and for a rectangle around it.
LEAST_SHARE, BOX_SHARE = 0.05, 0.10


#: Cells of a frame counted at once.
CELLS_AT_ONCE = 8192


def _frame_votes(x: np.ndarray, y: np.ndarray, angles: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Angle, offset and votes of the lines of one frame with at least so many votes."""
    turn = [k * math.pi / angles for k in range(angles)]
    c, s = np.array([math.cos(t) for t in turn]), np.array([math.sin(t) for t in turn])
    reach = int(max(np.abs(x).max(), np.abs(y).max())) * 2 + 2  # no offset lies beyond
    wide = 2 * reach + 1
    found, votes = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(x), CELLS_AT_ONCE):
        part = slice(at, at + CELLS_AT_ONCE)
        offset = np.floor(np.round(x[part, None] * c + y[part, None] * s, 9) + 0.5).astype(np.int64)
        line, n = np.unique_counts((offset + reach + wide * np.arange(angles)).ravel()) if wide * angles > 1 << 22 else _counted(offset + reach + wide * np.arange(angles), wide * angles)
        found, at_line = np.unique_inverse(np.concatenate([found, line])) if len(found) else (line, np.arange(len(line)))
        votes = np.bincount(at_line, np.concatenate([votes, n]), len(found)).astype(np.int64)
    strong = votes >= least
    return found[strong] // wide, found[strong] % wide - reach, votes[strong]


def _counted(lines: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(lines.ravel(), minlength=n)
    at = np.flatnonzero(counts)
    return at, counts[at]


def line_votes(cells: DataFrame, angles: int = 180, least: int = 1) -> DataFrame:
    """match_id, frame_idx, angle, offset, votes: set cells on each line x cos(a) + y sin(a) = offset, a in steps of the half turn.

    Only lines with at least so many votes are given. The cells of a frame, which its size bounds, are one group, so
    cells are shuffled and votes are not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, frame in enumerate(batch.column("cells")):
                x, y = (frame.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
                angle, offset, votes = _frame_votes(x, y, angles, least)
                if len(votes):
                    own = [pa.repeat(batch.column(c)[i], len(votes)) for c in FRAME]
                    yield pa.record_batch([*own, pa.array(angle, pa.int32()), pa.array(offset, pa.int32()), pa.array(votes)], names=[*FRAME, "angle", "offset", "votes"])

    packed = cells.where("x is not null and y is not null").groupBy(*FRAME).agg(F.collect_list(F.struct(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))).alias("cells"))
    kinds = [f"{c} {cells.schema[c].dataType.simpleString()}" for c in FRAME]
    return packed.mapInArrow(run, ", ".join([*kinds, "angle int, offset int, votes long"]))


def lines(votes: DataFrame, least: int = 80) -> DataFrame:
    """The lines with enough votes that no neighbour in angle and offset outdoes; of equals the first by angle, then offset."""
    strong = votes.where(F.col("votes") >= least)
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(o).alias("o")) for a in (-1, 0, 1) for o in (-1, 0, 1)])
    own = F.struct(F.col("votes"), (-F.col("angle")).alias("angle"), (-F.col("offset")).alias("offset"))
    near = strong.select(*FRAME, F.explode(steps).alias("d"), own.alias("line"), "angle", "offset")
    self_ = (F.col("d.a") == 0) & (F.col("d.o") == 0)
    best = near.groupBy(*FRAME, (F.col("angle") + F.col("d.a")).alias("angle"), (F.col("offset") + F.col("d.o")).alias("offset")).agg(F.max(F.when(self_, F.col("line"))).alias("line"), F.max(F.when(~self_, F.col("line"))).alias("other"))
    kept = best.where(F.col("line").isNotNull() & (F.col("other").isNull() | (F.col("line") > F.col("other"))))
    return kept.select(*FRAME, "angle", "offset", F.col("line.votes").alias("votes"))


def _simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Of an open chain, the points that Douglas and Peucker keep."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        base, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        length = math.hypot(*base)
        far = np.abs(base[0] * inner[:, 1] - base[1] * inner[:, 0]) / length if length else np.hypot(*inner.T)
        at = int(far.argmax())
        if far[at] > tolerance:
            keep[a + 1 + at] = True
            stack += [(a, a + 1 + at), (a + 1 + at, b)]
    return points[keep]


def corners_of(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Of a closed outline: cut at two points that lie far apart, both chains simplified."""
    at = int(np.hypot(*(points - points[0]).T).argmax())
    start = int(np.hypot(*(points - points[at]).T).argmax())
    turned = np.roll(points, -start, axis=0)
    half = (at - start) % len(points)
    first, second = _simplified(turned[: half + 1], tolerance), _simplified(np.concatenate([turned[half:], turned[:1]]), tolerance)
    return np.concatenate([first[:-1], second[:-1]])


def _hull(points: np.ndarray) -> np.ndarray:
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(chain: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in chain:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def smallest_box(points: np.ndarray) -> np.ndarray:
    """The corners of the rectangle of least area around the points, which has a side on their hull."""
    hull = _hull(points.astype(float))
    if len(hull) < 3:
        return np.repeat(hull, 4, axis=0)[:4]
    best = (math.inf, hull[:4])
    for side in np.roll(hull, -1, axis=0) - hull:
        u = side / math.hypot(*side)
        v = np.array([-u[1], u[0]])
        a, b = hull @ u, hull @ v
        area = (a.max() - a.min()) * (b.max() - b.min())
        if area < best[0] - 1e-9:
            best = area, np.array([u * i + v * j for i, j in ((a.min(), b.min()), (a.max(), b.min()), (a.max(), b.max()), (a.min(), b.max()))])
    return best[1]


def court_corners(runs: DataFrame, width: int, height: int, box_only: float | None = None) -> DataFrame:
    """match_id, sample, idx, x, y, estimated: the corners of the largest component of each frame, as `calibrations` takes them.

    The outline's corners at the first tolerance that leaves four; else, of a component that covers enough, the smallest
    rectangle. With `box_only`, a least share of the frame, that rectangle at once (courts by colour).
    """
    found = components(runs, outlines=True)
    largest = found.groupBy(*FRAME).agg(F.max_by(F.struct("area", "perimeter", "points"), F.struct("area", -F.col("component"))).alias("b")).select(*FRAME, "b.*")
    size = width * height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for match_id, frame, area, perimeter, outline in zip(*(batch.column(c) for c in (*FRAME, "area", "perimeter", "points")), strict=True):
                points = np.stack([outline.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1).astype(float)
                corners = _corners(points, area.as_py(), perimeter.as_py())
                out += [(match_id.as_py(), frame.as_py(), i, float(x), float(y), False) for i, (x, y) in enumerate(corners)]
            if out:
                kinds = pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["match_id", "sample", "idx", "x", "y", "estimated"])

    def _corners(points: np.ndarray, area: float, perimeter: float) -> np.ndarray:
        if box_only is not None:
            return smallest_box(points) if area >= box_only * size else points[:0]
        if area <= LEAST_SHARE * size:
            return points[:0]
        for share in TOLERANCES:
            corners = corners_of(points, share * perimeter)
            if len(corners) == 4:
                return corners
        return smallest_box(points) if area > BOX_SHARE * size else points[:0]

    return largest.mapInArrow(run, "match_id long, sample long, idx int, x double, y double, estimated boolean")


def gated(corners: DataFrame, found: DataFrame, least: int = 4) -> DataFrame:
    """Only the corners of frames with at least so many straight lines (match_id, frame_idx, one row a line)."""
    enough = found.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("match_id", F.col("frame_idx").alias("sample"))
    return corners.join(enough, ["match_id", "sample"], "left_semi")


def edge_cells(runs: DataFrame) -> DataFrame:
    """match_id, frame_idx, y, x: set pixels with a neighbour above, below or beside that isn't set."""
    ends = runs.select(*FRAME, "y", F.explode(F.array("x0", "x1")).alias("x"))
    w = Window.partitionBy(*FRAME, "x").orderBy("y")
    cells = runs.select(*FRAME, "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    near = cells.withColumns({"above": F.lag("y").over(w), "below": F.lead("y").over(w)})
    open_ = near.where("above is null or above < y - 1 or below is null or below > y + 1").select(*FRAME, "y", "x")
    return ends.unionByName(open_).distinct()
