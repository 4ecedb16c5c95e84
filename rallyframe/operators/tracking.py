"""Detections to tracks: predicted boxes, overlap, and an assignment that is best as a whole, with births and deaths.

Tracks of a match depend on the frames before, so these are worked on in order; rows are streamed through a task and only
the living tracks are kept. Where nothing is seen for longer than a track lives, none is left: such islands of a match are
worked on by themselves, and their tracks numbered on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .ordered import Rows, Stepper, in_order, islands


@dataclass(frozen=True)
class TrackRules:
    """sure: detections that may begin a track and are assigned first; faint ones only go on with a track that is left."""

    sure: float = 0.35
    faint: float = 0.1
    overlap: float = 0.3
    patience: int = 30  # frames that a track lives unseen
    inertia: float = 0.5  # share of the earlier speed in the new one


#: A track: id, the box (x1, y1, x2, y2), speed in x and y per frame, the frame where it was seen last.
_WIDTH = 8


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of all boxes of a with all of b; 0 for boxes without area."""
    sides = np.maximum(np.minimum(a[:, None, 2:], b[None, :, 2:]) - np.maximum(a[:, None, :2], b[None, :, :2]), 0)
    both = sides[:, :, 0] * sides[:, :, 1]
    area = lambda v: np.maximum(v[:, 2] - v[:, 0], 0) * np.maximum(v[:, 3] - v[:, 1], 0)
    joint = area(a)[:, None] + area(b)[None, :] - both
    return np.divide(both, joint, out=np.zeros_like(both), where=joint > 0)


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs with the largest sum of gains; pairs without gain are left out.

    Shortest augmenting paths with potentials, a row at a time.
    """
    if not gain.size:
        return []
    able = gain > 0
    if (able.sum(axis=0) < 2).all() and (able.sum(axis=1) < 2).all():  # nothing to choose
        return list(zip(*(a.tolist() for a in np.nonzero(able)), strict=True))
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain)
    n, m = cost.shape
    u, v, of = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, n)  # of[j]: row of column j; m is the column to begin from
    for i in range(n):
        of[m], at = i, m
        least, came, done = np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        while of[at] != n:
            done[at] = True
            row = of[at]
            reach = cost[row] - u[row] - v[:m]
            nearer = ~done[:m] & (reach < least[:m])
            least[:m][nearer], came[:m][nearer] = reach[nearer], at
            free = np.where(done[:m], np.inf, least[:m])
            to = int(free.argmin())
            step = free[to]
            u[of[done]] += step
            v[done] -= step
            least[:m][~done[:m]] -= step
            at = to
        while at != m:
            of[at] = of[came[at]]
            at = came[at]
    pairs = [(int(of[j]), j) for j in range(m) if of[j] != n]
    return sorted((j, i) if turned else (i, j) for i, j in pairs if cost[i, j] < 0)


class TrackStepper(Stepper):
    """Rows: frame_idx, det_seq, x1, y1, x2, y2, confidence. Gives frame_idx, det_seq, track_id of every detection that has a track."""

    columns = ("frame_idx", "det_seq", "x1", "y1", "x2", "y2", "confidence")
    order = ("frame_idx", "det_seq")
    state = "tracks array<double>, following long"
    out = "frame_idx long, det_seq int, track_id long"

    def __init__(self, rules: TrackRules | None = None) -> None:
        self.rules = rules or TrackRules()

    def begin(self) -> tuple:
        return [], 1

    def step(self, state: tuple, rows: Rows) -> tuple[tuple, Rows]:
        tracks, following = np.array(state[0], float).reshape(-1, _WIDTH), int(state[1])
        out: Rows = []
        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to][0] == rows[at][0]:
                to += 1
            tracks, following, found = self._frame(tracks, following, rows[at:to])
            out += found
            at = to
        return (tracks.ravel().tolist(), following), out

    def _frame(self, tracks: np.ndarray, following: int, rows: Rows) -> tuple[np.ndarray, int, Rows]:
        """The tracks after one frame and the detections that have one."""
        r, frame = self.rules, float(rows[0][0])
        rows = [row for row in rows if all(x is not None and x == x for x in row[2:])]
        boxes = np.array([row[2:6] for row in rows], float).reshape(-1, 4)
        sure = np.array([row[6] >= r.sure for row in rows], bool)
        faint = np.array([r.faint <= row[6] < r.sure for row in rows], bool)
        tracks = tracks[frame - tracks[:, 7] <= r.patience]
        ahead = tracks[:, 1:5] + np.tile(tracks[:, 5:7] * (frame - tracks[:, 7])[:, None], 2)
        open_, of = np.ones(len(tracks), bool), np.full(len(rows), -1)
        for group in (sure, faint):
            t, d = np.flatnonzero(open_), np.flatnonzero(group)
            if not len(t) or not len(d):
                continue
            gain = overlaps(ahead[t], boxes[d])
            for i, j in assign(np.where(gain >= r.overlap, gain, 0.0)):
                of[d[j]], open_[t[i]] = t[i], False
        out: Rows = []
        born = []
        for n, row in enumerate(rows):
            if of[n] >= 0:
                track = tracks[of[n]]
                moved = (boxes[n, :2] + boxes[n, 2:] - track[1:3] - track[3:5]) / 2 / max(frame - track[7], 1.0)
                track[5:7] = r.inertia * track[5:7] + (1 - r.inertia) * moved
                track[1:5], track[7] = boxes[n], frame
                out.append((row[0], row[1], int(track[0])))
            elif sure[n]:
                born.append([following, *boxes[n], 0.0, 0.0, frame])
                out.append((row[0], row[1], following))
                following += 1
        if born:
            tracks = np.concatenate([tracks, np.array(born, float)])
        return tracks, following, out


def track_boxes(boxes: DataFrame, rules: TrackRules | None = None) -> DataFrame:
    """match_id, frame_idx, det_seq, track_id from match_id and the columns of TrackStepper, in any order.

    Detections that are fainter than any rule takes, or lack a coordinate, have no track and no row.
    """
    rows = boxes.select("match_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("det_seq").cast("int").alias("det_seq"), *TrackStepper.columns[2:])
    rules = rules or TrackRules()
    found = stored(in_order(islands(rows, ["match_id"], rules.patience), ["match_id", "island"], TrackStepper(rules)), "tracks")
    w = Window.partitionBy("match_id").orderBy("island").rowsBetween(Window.unboundedPreceding, -1)
    births = found.groupBy("match_id", "island").agg(F.max("track_id").alias("born"))
    before = births.select(F.col("match_id").alias("m"), F.col("island").alias("i"), F.coalesce(F.sum("born").over(w), F.lit(0)).alias("before"))
    numbered = found.join(before, found["match_id"].eqNullSafe(before["m"]) & (found["island"] == before["i"]))
    return numbered.select("match_id", "frame_idx", "det_seq", (F.col("track_id") + F.col("before")).alias("track_id"))
