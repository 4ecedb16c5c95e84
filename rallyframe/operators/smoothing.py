"""Trajectory smoothing, cut so that a match of any length is many tasks.

The Kalman filter is a chain of affine steps of Gaussians, which compose associatively: a segment of a match is one
element however many rows it has, the state before each segment comes from the elements of those before it, and then
every segment is filtered by itself. The quadratic fill depends on earlier fills only where gaps lie close together, so
such clusters are worked on by themselves and all other rows never reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..storage import stored

#: Frames of a segment.
SEGMENT = 4096
_ROWS = ("frame_idx", "x_px", "y_px", "confidence")
_KIND = "match_id long, frame_idx long, x_px double, y_px double, confidence double"

#: An element of n steps: a (n, 2, 2), b (n, 2, 2: state by axis), c (n, 2, 2), eta (n, 2, 2: state by axis), j (n, 2, 2).
Element = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Position and velocity by axis, and the covariance that both axes share.
State = tuple[np.ndarray, np.ndarray]
_STEP = np.array([[1.0, 1.0], [0.0, 1.0]])


def _steps(x: np.ndarray, y: np.ndarray, t: Thresholds) -> Element:
    """An element for each row: one step of constant velocity and, where the ball is seen, its position."""
    seen = ~np.isnan(x)
    noise, at = np.eye(2) * t.kalman_q, np.array([[1.0, 0.0]])
    spread = t.kalman_q + t.kalman_r
    gain = noise @ at.T / spread
    left = np.eye(2) - gain @ at
    z = np.nan_to_num(np.stack([x, y], axis=1))[:, None, :]
    pick = lambda a, b: np.where(seen[:, None, None], a, b)
    back = _STEP.T @ at.T / spread
    none = np.zeros((2, 2))
    return pick(left @ _STEP, _STEP), pick(gain @ z, none), pick(left @ noise, noise), pick(back @ z, none), pick(back @ at @ _STEP, none)


def _then(p: Element, q: Element) -> Element:
    """p, and q after it."""
    a1, b1, c1, e1, j1 = p
    a2, b2, c2, e2, j2 = q
    turn = lambda m: np.swapaxes(m, -1, -2)
    ahead = a2 @ np.linalg.inv(np.eye(2) + c1 @ j2)
    back = turn(a1) @ np.linalg.inv(np.eye(2) + j2 @ c1)
    return ahead @ a1, ahead @ (b1 + c1 @ e2) + b2, ahead @ c1 @ turn(a2) + c2, back @ (e2 - j2 @ b1) + e1, back @ j2 @ a1 + j1


def _composed(x: np.ndarray, y: np.ndarray, t: Thresholds) -> Element:
    """All rows as one element: neighbours are joined until one is left."""
    e = _steps(x, y, t)
    while len(e[0]) > 1:
        even = len(e[0]) // 2 * 2
        e, odd = _then(tuple(m[:even:2] for m in e), tuple(m[1:even:2] for m in e)), tuple(m[even:] for m in e)
        e = tuple(np.concatenate(pair) for pair in zip(e, odd, strict=True))
    return e


def _after(state: State, e: Element) -> State:
    mean, p = state
    a, b, c, eta, j = (m[0] for m in e)
    ahead = a @ np.linalg.inv(np.eye(2) + p @ j)
    return ahead @ (mean + p @ eta) + b, ahead @ p @ a.T + c


def _filtered(x: np.ndarray, y: np.ndarray, conf: np.ndarray, state: list[float], misses: int, max_gap: int, t: Thresholds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows after a state (px, py, vx, vy and the covariance a, b; b, c); `misses` rows before them were hidden."""
    px, py, vx, vy, a, b, c = state
    out_x, out_y, out_c = x.copy(), y.copy(), conf.copy()
    for i in range(len(x)):
        px, py = px + vx, py + vy
        a, b, c = a + 2 * b + c + t.kalman_q, b + c, c + t.kalman_q
        if x[i] == x[i]:
            k0, k1 = a / (a + t.kalman_r), b / (a + t.kalman_r)
            rx, ry = x[i] - px, y[i] - py
            px, py, vx, vy = px + k0 * rx, py + k0 * ry, vx + k1 * rx, vy + k1 * ry
            a, b, c = (1 - k0) * a, (1 - k0) * b, c - k1 * b
            misses = 0
            out_x[i], out_y[i] = px, py
        else:
            misses += 1
            if misses <= max_gap:
                out_x[i], out_y[i], out_c[i] = px, py, t.fill_confidence
    return out_x, out_y, out_c


def _known(ball: DataFrame) -> DataFrame:
    whole = [F.col(c).cast("long").alias(c) for c in ("match_id", "frame_idx")]
    return ball.select(*whole, *[F.col(c).cast("double").alias(c) for c in _ROWS[1:]])


def _packed(ball: DataFrame, *keys: str | Column, more: tuple[str, ...] = ()) -> DataFrame:
    """The keys and `rows`: the rows of a group in the order of frames."""
    return ball.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_ROWS, *more))).alias("rows"))


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """frame_idx, x, y and confidence of each packed group; a hidden ball is NaN in both."""
    flat, ends = column.flatten(), column.offsets.to_numpy()
    ends = ends - ends[0]
    frame = flat.field("frame_idx").to_numpy(zero_copy_only=False)
    x, y, conf = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in _ROWS[1:])
    hidden = np.isnan(x) | np.isnan(y)
    x, y = np.where(hidden, np.nan, x), np.where(hidden, np.nan, y)
    for a, b in zip(ends, ends[1:], strict=False):
        yield frame[a:b], x[a:b], y[a:b], conf[a:b]


def _rows_of(match_id: int, frame: np.ndarray, x: np.ndarray, y: np.ndarray, conf: np.ndarray) -> pa.RecordBatch:
    """A batch of _KIND; NaN is null again."""
    place = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
    columns = [pa.array(np.full(len(frame), match_id), pa.int64()), pa.array(frame, pa.int64()), place(x), place(y), place(conf)]
    return pa.record_batch(columns, names=["match_id", *_ROWS])


def _segments(ball: DataFrame, t: Thresholds, size: int) -> DataFrame:
    """match_id, segment, rows, element, n, seen, trailing (hidden rows at the end), first_x, first_y; a row a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {c: [] for c in ("element", "n", "seen", "trailing", "first_x", "first_y")}
            for _, x, y, _ in _lists(batch.column("rows")):
                at = np.flatnonzero(~np.isnan(x))
                element = np.concatenate([m[0].ravel() for m in _composed(x, y, t)])
                first = (float(x[at[0]]), float(y[at[0]])) if len(at) else (None, None)
                for c, v in zip(found, (element.tolist(), len(x), len(at), len(x) - 1 - int(at[-1]) if len(at) else len(x), *first), strict=True):
                    found[c].append(v)
            kinds = (pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            more = [pa.array(v, k) for v, k in zip(found.values(), kinds, strict=True)]
            yield pa.record_batch([*batch.columns, *more], names=[*batch.schema.names, *found])

    kind = "match_id long, segment long, rows array<struct<frame_idx:long,x_px:double,y_px:double,confidence:double>>, element array<double>, n long, seen long, trailing long, first_x double, first_y double"
    segment = F.floor(F.col("frame_idx") / size).alias("segment")
    return stored(_packed(_known(ball), "match_id", segment).mapInArrow(run, kind), "segments")


def _states(segments: DataFrame, t: Thresholds) -> DataFrame:
    """match_id, segment, state, misses: what each segment begins with, null in a match where the ball is never seen.

    A match is a row a segment here, some thousandths of its rows.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("segment")
        first = rows[rows["seen"] > 0]
        if not len(first):
            return pd.DataFrame({"match_id": rows["match_id"], "segment": rows["segment"], "state": None, "misses": 0})
        mean = np.array([[first["first_x"].iloc[0], first["first_y"].iloc[0]], [0.0, 0.0]])
        state, misses = (mean, np.eye(2) * t.kalman_p0), 0
        states, missed = [], []
        for element, n, seen, trailing in zip(rows["element"], rows["n"], rows["seen"], rows["trailing"], strict=True):
            (place, speed), p = state
            states.append([*place.tolist(), *speed.tolist(), p[0, 0], p[0, 1], p[1, 1]])
            missed.append(misses)
            state = _after(state, tuple(np.asarray(element).reshape(5, 1, 2, 2)))
            misses = trailing if seen else misses + n
        return pd.DataFrame({"match_id": rows["match_id"], "segment": rows["segment"], "state": states, "misses": missed})

    few = segments.select("match_id", "segment", "element", "n", "seen", "trailing", "first_x", "first_y")
    return few.groupBy("match_id").applyInPandas(run, "match_id long, segment long, state array<double>, misses long")


def kalman_smooth(ball: DataFrame, max_gap: int = DEFAULT.max_gap, t: Thresholds = DEFAULT, segment: int = SEGMENT) -> DataFrame:
    """Filtered positions; the first max_gap rows of any gap, a leading one too, are predicted with low confidence.

    Constant velocity, one step a row. The filter starts at the match's first seen position, and a match without any
    stays as it is. A position that is known in one axis only counts as hidden.
    """
    segments = _segments(ball, t, segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("match_id").to_pylist(), batch.column("state").to_pylist(), batch.column("misses").to_pylist(), strict=True)
            for (match_id, state, misses), (frame, x, y, conf) in zip(keys, _lists(batch.column("rows")), strict=True):
                yield _rows_of(match_id, frame, *(_filtered(x, y, conf, state, misses, max_gap, t) if state else (x, y, conf)))

    begun = segments.select("match_id", "segment", "rows").join(_states(segments, t), ["match_id", "segment"])
    return begun.select("match_id", "state", "misses", "rows").mapInArrow(run, _KIND)


def _quadratic(frame: np.ndarray, x: np.ndarray, y: np.ndarray, conf: np.ndarray, max_gap: int, t: Thresholds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fill whole interior gaps of at most max_gap rows from a parabola through the rows around; filled rows count."""
    x, y, conf = x.copy(), y.copy(), conf.copy()
    hidden = np.isnan(x)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hidden, [False]]).astype(int)))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a > max_gap or a == 0 or b == len(x):
            continue
        around = np.r_[max(0, a - t.quadratic_context) : a, b : min(len(x), b + t.quadratic_context)]
        around = around[~np.isnan(x[around])]
        gap = frame[a:b]
        if len(around) >= 3:
            begin = frame[a]  # frames are counted from the gap on, as squares of large numbers lose digits
            for v in (x, y):
                v[a:b] = np.polyval(np.polyfit((frame[around] - begin).astype(float), v[around], 2), gap - begin)
        elif len(around) == 2:
            i, j = around
            r = (gap - frame[i]) / max(frame[j] - frame[i], 1)
            for v in (x, y):
                v[a:b] = v[i] * (1 - r) + v[j] * r
        else:
            continue
        conf[a:b] = t.fill_confidence
    return x, y, conf


def short_gaps(ball: DataFrame, max_gap: int) -> DataFrame:
    """The rows with their place in the match, and open: whether a row is hidden in a run of at most max_gap such rows."""
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    hidden = F.col("x_px").isNull() | F.col("y_px").isNull()
    rows = ball.select("match_id", *_ROWS, F.row_number().over(w).alias("place"), hidden.alias("hidden"), F.count_if(~hidden).over(w).alias("run"))
    size = F.count_if("hidden").over(Window.partitionBy("match_id", "run"))
    return rows.withColumn("size", size).select("match_id", *_ROWS, "place", (F.col("hidden") & (F.col("size") <= max_gap)).alias("open"))


def gap_clusters(gaps: DataFrame, context: int) -> DataFrame:
    """match_id, cluster and the rows of each: short gaps with fewer than `context` rows between them, and as many around.

    A row between two clusters can be in both. Rows that are near no short gap are in no cluster.
    """
    w = Window.partitionBy("match_id").orderBy("frame_idx")
    rows = gaps.withColumn("gap", F.when(F.col("open"), F.col("place")))
    rows = rows.withColumns({"before": F.max("gap").over(w.rowsBetween(Window.unboundedPreceding, -1)), "after": F.min("gap").over(w.rowsBetween(1, context))})
    begins = F.col("open") & F.coalesce(F.col("place") - F.col("before") > context, F.lit(True))
    rows = rows.withColumn("cluster", F.sum(begins.cast("long")).over(w))
    back = F.col("open") | (F.col("place") - F.col("before") <= context)
    ahead = ~F.col("open") & F.col("after").isNotNull() & F.coalesce(F.col("after") - F.col("before") > context, F.lit(True))
    of = F.array_compact(F.array(F.when(back, F.col("cluster")), F.when(ahead, F.col("cluster") + 1)))
    return rows.select("match_id", F.explode(of).alias("cluster"), *_ROWS, "open")


def quadratic_fill(ball: DataFrame, max_gap: int = DEFAULT.max_gap, t: Thresholds = DEFAULT) -> DataFrame:
    """Whole interior gaps of at most max_gap rows from a parabola through the rows around, of which filled ones count.

    A position that is known in one axis only counts as hidden.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at = [], 0
            open_ = batch.column("rows").flatten().field("open").to_numpy(zero_copy_only=False)
            for match_id, (frame, x, y, conf) in zip(batch.column("match_id").to_pylist(), _lists(batch.column("rows")), strict=True):
                own, at = open_[at : at + len(frame)], at + len(frame)
                out.append(_rows_of(match_id, frame[own], *(v[own] for v in _quadratic(frame, x, y, conf, max_gap, t))))
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()

    gaps = short_gaps(_known(ball), max_gap)
    packed = _packed(gap_clusters(gaps, t.quadratic_context), "match_id", "cluster", more=("open",))
    filled = packed.select("match_id", "rows").mapInArrow(run, _KIND)
    return gaps.where(~F.col("open")).select("match_id", *_ROWS).unionByName(filled)
