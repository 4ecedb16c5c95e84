"""What moves before a fixed camera: a mixture of Gaussians for every pixel, learned frame by frame.

A frame is cut into tiles, and a tile's pixels through time are one ordered key, so a match is as many tasks as it has
tiles. The model of a tile is the state of its step; what is told is the runs of pixels that no likely background explains.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Rows, Stepper, in_order


@dataclass(frozen=True)
class MixtureRules:
    """Distances are in variances; `history` frames count, `ratio` of the weight is background."""

    history: int = 120
    modes: int = 3
    far: float = 36.0
    near: float = 9.0
    ratio: float = 0.9
    prior: float = 0.05
    first: float = 15.0
    least: float = 4.0
    most: float = 75.0


class MixtureStepper(Stepper):
    """Rows: step (order in time), told (whether runs are given), frame_idx, pixels (the tile's bytes, line by line)."""

    columns = ("step", "told", "frame_idx", "pixels")
    order = ("step",)
    state = "seen long, weight array<double>, mean array<double>, variance array<double>"
    out = "frame_idx long, y long, x0 long, x1 long"

    def __init__(self, width: int, rules: MixtureRules | None = None) -> None:
        self.width, self.rules = width, rules or MixtureRules()

    def begin(self) -> tuple:
        return 0, [], [], []

    def step(self, state: tuple, rows: Rows) -> tuple[tuple, Rows]:
        k, seen, out = self.rules.modes, int(state[0]), []
        w, m, v = (np.array(a, float).reshape(k, -1) for a in state[1:])
        for _, told, frame, pixels in rows:
            x = np.frombuffer(pixels, np.uint8).astype(float)
            if not seen:
                w, m, v = (np.zeros((k, len(x))) for _ in range(3))
            seen += 1
            moving = self._learn(w, m, v, x, 1 / min(2 * seen, self.rules.history))
            if told:
                out += [(frame, *r) for r in runs_of(moving.reshape(-1, self.width))]
        return (seen, w.ravel().tolist(), m.ravel().tolist(), v.ravel().tolist()), out

    def _learn(self, w: np.ndarray, m: np.ndarray, v: np.ndarray, x: np.ndarray, rate: float) -> np.ndarray:
        """Update the modes, heaviest first, by a frame; whether each pixel was foreground."""
        r = self.rules
        apart = (x - m) ** 2
        below = np.cumsum(w, axis=0) - w
        known = w > 0
        background = (known & (below < r.ratio) & (apart < r.far * v)).any(axis=0)
        close = known & (apart < r.near * v)
        hit = close & (np.cumsum(close, axis=0) == 1)
        w -= rate * (w + r.prior) * known
        w[hit] += rate
        share = np.divide(rate, w, out=np.zeros_like(w), where=hit & (w > 0))
        m += share * (x - m) * hit
        v += share * (apart - v) * hit
        np.clip(v, r.least, r.most, out=v, where=hit)
        w[w < 0] = 0
        fresh = ~hit.any(axis=0)
        if fresh.any():
            last = w.argmin(axis=0)[fresh], np.flatnonzero(fresh)
            w[last], m[last], v[last] = rate, x[fresh], r.first
        w /= w.sum(axis=0)
        by = np.argsort(-w, axis=0, kind="stable")
        for a in (w, m, v):
            a[:] = np.take_along_axis(a, by, axis=0)
        return ~background


def runs_of(mask: np.ndarray) -> list[tuple[int, int, int]]:
    """(y, x0, x1) of a mask's runs."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    return list(zip(y.tolist(), x0.tolist(), (np.nonzero(edge == -1)[1] - 1).tolist(), strict=True))


def foreground(tiles: DataFrame, width: int, height: int, warm_up: int = 60, rules: MixtureRules | None = None) -> DataFrame:
    """match_id, frame_idx, y, x0, x1 of what moves, from tiles (match_id, tile_x, tile_y, frame_idx, pixels) of that size.

    The model sees the first `warm_up` frames before it tells of any, and then all frames from the first on. Runs end at a
    tile's border; `components` joins what touches.
    """
    warm = tiles.where(F.col("frame_idx") < warm_up).select("*", (F.col("frame_idx") - (1 << 40)).alias("step"), F.lit(False).alias("told"))
    both = warm.unionByName(tiles.select("*", F.col("frame_idx").cast("long").alias("step"), F.lit(True).alias("told")))
    runs = in_order(both, ["match_id", "tile_x", "tile_y"], MixtureStepper(width, rules))
    x = F.col("tile_x") * width
    return runs.select("match_id", "frame_idx", (F.col("y") + F.col("tile_y") * height).alias("y"), (F.col("x0") + x).alias("x0"), (F.col("x1") + x).alias("x1"))
