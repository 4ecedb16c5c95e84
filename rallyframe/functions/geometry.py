"""Court geometry as column expressions: homography, corners, polygons, zones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds

#: Court positions of the corners TL, TR, BR, BL in metres.
COURT_CORNERS_M = ((0.0, 20.0), (10.0, 20.0), (10.0, 0.0), (0.0, 0.0))
#: Frame shares of the estimated corners: top x, top y, bottom x, bottom y.
ESTIMATE = (0.22, 0.10, 0.06, 0.93)


def homography_columns(matrix: str | Column) -> list[Column]:
    """The nine entries of an array<array<double>> column, row by row."""
    matrix = F.col(matrix) if isinstance(matrix, str) else matrix
    return [matrix[i][j] for i in range(3) for j in range(3)]


def literal_homography(matrix: Sequence[Sequence[float]]) -> list[Column]:
    return [F.lit(float(x)) for row in matrix for x in row]


def to_court(x: Column, y: Column, h: Sequence[Column]) -> tuple[Column, Column]:
    """Pixel to court metres by a 3x3 homography; a vanishing denominator gives 0, a null position or homography null."""
    w = h[6] * x + h[7] * y + h[8]
    seen = x.isNotNull() & y.isNotNull() & h[8].isNotNull()
    safe = F.when(F.abs(w) > 1e-300, w)
    place = lambda n: F.when(seen, F.coalesce(n / safe, F.lit(0.0)))
    return place(h[0] * x + h[1] * y + h[2]), place(h[3] * x + h[4] * y + h[5])


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def fit_homography(corners_px: Sequence[Sequence[float]], corners_m: Sequence[Sequence[float]] = COURT_CORNERS_M) -> list[list[float]]:
    """The homography through four point pairs, by the 8x8 linear system."""
    rows, right = [], []
    for (x, y), (u, v) in zip(corners_px, corners_m, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    h = np.linalg.solve(np.array(rows, dtype=float), np.array(right, dtype=float))
    return [[*map(float, h[:3])], [*map(float, h[3:6])], [*map(float, h[6:]), 1.0]]


def homography_of_corners(tl: Column, tr: Column, br: Column, bl: Column, t: Thresholds = DEFAULT) -> Column:
    """The homography of four corners (structs x, y) as array<array<double>>, null where they give none.

    In closed form: the unit square goes to the corners by a projective map, whose inverse, scaled to the court, is
    wanted. The last entry is 1.
    """
    x0, y0, x1, y1, x2, y2, x3, y3 = (p[c].cast("double") for p in (bl, br, tr, tl) for c in ("x", "y"))
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    dx1, dy1, dx2, dy2 = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    area = dx1 * dy2 - dx2 * dy1
    g, h = F.try_divide(sx * dy2 - dx2 * sy, area), F.try_divide(dx1 * sy - sx * dy1, area)
    a, b, d, e = x1 - x0 + g * x1, x3 - x0 + h * x3, y1 - y0 + g * y1, y3 - y0 + h * y3
    inverse = [[e - y0 * h, x0 * h - b, b * y0 - x0 * e], [y0 * g - d, a - x0 * g, x0 * d - a * y0], [d * h - e * g, b * g - a * h, a * e - b * d]]
    scale = (t.court_width_m, t.court_length_m, 1.0)
    entry = lambda i, j: F.try_divide(inverse[i][j] * F.lit(scale[i]), inverse[2][2])
    matrix = F.array(*[F.array(*[entry(i, j) for j in range(3)]) for i in range(3)])
    return F.when(F.forall(F.flatten(matrix), lambda v: v.isNotNull()), matrix)


def estimated_corners(width: Column, height: Column) -> list[tuple[Column, Column]]:
    """TL, TR, BR, BL from the frame's size, cut to whole pixels."""
    tx, ty, bx, by = (F.floor(side * F.lit(share)) for side, share in zip((width, height, width, height), ESTIMATE, strict=True))
    return [(tx, ty), (width - tx, ty), (width - bx, by), (bx, by)]


def ordered_corners(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, corner (tl, tr, br, bl), x, y from rows (keys, idx, x, y); the first point wins a tie."""
    point = F.struct("x", "y")
    low = lambda key: F.min_by(point, F.struct(key, F.col("idx")))
    add, sub = F.col("x") + F.col("y"), F.col("y") - F.col("x")
    wide = points.groupBy(*keys).agg(low(add).alias("tl"), low(sub).alias("tr"), low(-add).alias("br"), low(-sub).alias("bl"))
    corners = F.array(*[F.struct(F.lit(c).alias("corner"), F.col(c)["x"].alias("x"), F.col(c)["y"].alias("y")) for c in ("tl", "tr", "br", "bl")])
    return wide.select(*keys, F.explode(corners).alias("c")).select(*keys, "c.*")


def in_expanded_polygon(x: Column, y: Column, corners: Sequence[tuple[Column, Column]], margin: float = DEFAULT.court_margin_px) -> Column:
    """Whether a point is in or on a convex quadrilateral whose vertices move `margin` pixels away from their centre."""
    cx, cy = (sum((c[i] for c in corners[1:]), corners[0][i]) / 4 for i in (0, 1))
    out = []
    for px, py in corners:
        far = F.greatest(distance(px, py, cx, cy), F.lit(1.0))
        out.append((px + (px - cx) * (F.lit(margin) / far), py + (py - cy) * (F.lit(margin) / far)))
    sides = []
    for (ax, ay), (bx, by) in zip(out, [*out[1:], out[0]], strict=True):
        sides.append((bx - ax) * (y - ay) - (by - ay) * (x - ax))
    every = lambda test: test(sides[0]) & test(sides[1]) & test(sides[2]) & test(sides[3])
    return every(lambda s: s >= 0) | every(lambda s: s <= 0)


def foot_point(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Middle of a box's lower edge."""
    return (x1 + x2) / 2, y2


def grid_cell(x: Column, top: float) -> Column:
    """Whole metre of a position, clipped to [0, top]; null without one."""
    return F.when(x.isNotNull(), F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(top))).cast("int"))


def near_edge(x: Column, y: Column, margin: float, t: Thresholds = DEFAULT) -> Column:
    """Strictly within `margin` metres of an edge, or outside."""
    return (x < margin) | (x > t.court_width_m - margin) | (y < margin) | (y > t.court_length_m - margin)


def at_net(y: Column, t: Thresholds = DEFAULT) -> Column:
    return F.coalesce((y > t.net_low_m) & (y < t.net_high_m), F.lit(False))


def at_back(y: Column, t: Thresholds = DEFAULT) -> Column:
    return F.coalesce((y < t.back_m) | (y > t.court_length_m - t.back_m), F.lit(False))


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: int = DEFAULT.crop_pad) -> list[Column]:
    """A box padded and clamped to the frame, coordinates cut to whole pixels."""
    whole = lambda c: c.cast("int")  # noqa: E731  truncates
    return [F.greatest(F.lit(0), whole(x1) - pad), F.greatest(F.lit(0), whole(y1) - pad), F.least(width, whole(x2) + pad), F.least(height, whole(y2) + pad)]
