"""Smoothing in pieces against the whole track in one go."""

import random

import numpy as np
import pytest

from rallyframe.config import DEFAULT
from rallyframe.operators import smoothing

KIND = "match_id long, frame_idx long, x_px double, y_px double, confidence double"


def track(match_id, n, seed, hidden=0.3, long_gaps=True, start=0):
    rng = random.Random(seed)
    rows, frame, gone = [], start, 0
    for _ in range(n):
        frame += rng.choice([1, 1, 1, 2, 90])
        gone = gone - 1 if gone else (rng.choice([1, 2, 7, 40]) if long_gaps else 1) * (rng.random() < hidden)
        rows.append((match_id, frame, None if gone else rng.uniform(0, 1280), None if gone else rng.uniform(0, 720), rng.random()))
    return rows


def plain_kalman(rows, max_gap, t=DEFAULT):
    """Four states in matrix form, a row at a time."""
    first = next((r for r in rows if r[2] is not None), None)
    if first is None:
        return [r[2:] for r in rows]
    f = np.array([[1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 0], [0, 0, 0, 1.0]])
    h, s, p, misses, out = np.eye(2, 4), np.array([first[2], first[3], 0, 0]), np.eye(4) * t.kalman_p0, 0, []
    for _, _, x, y, conf in rows:
        s, p = f @ s, f @ p @ f.T + np.eye(4) * t.kalman_q
        if x is not None:
            k = p @ h.T @ np.linalg.inv(h @ p @ h.T + np.eye(2) * t.kalman_r)
            s, p, misses = s + k @ (np.array([x, y]) - h @ s), (np.eye(4) - k @ h) @ p, 0
            out.append((s[0], s[1], conf))
        else:
            misses += 1
            out.append((s[0], s[1], t.fill_confidence) if misses <= max_gap else (None, None, conf))
    return out


def near(a, b):
    return all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-6) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


def by_match(df):
    out = {}
    for r in df.orderBy("match_id", "frame_idx").collect():
        out.setdefault(r.match_id, []).append((r.x_px, r.y_px, r.confidence))
    return out


TRACKS = {1: track(1, 700, 1), 2: track(2, 300, 2, start=5000), 3: track(3, 40, 3, hidden=1.1), 4: [(4, i, None, None, 0.5) for i in range(50)], 5: track(5, 1, 4), 6: [(6, i, None, None, 0.0) for i in range(200)] + track(6, 90, 5, start=200)}


@pytest.mark.parametrize("segment", [16, 1000, 1_000_000])
def test_segments_equal_the_sequential_filter(spark, segment):
    df = spark.createDataFrame([r for rows in TRACKS.values() for r in rows], KIND).repartition(7)
    got = by_match(smoothing.kalman_smooth(df, 6, segment=segment))
    assert all(near(got[m], plain_kalman(rows, 6)) for m, rows in TRACKS.items())


def test_one_match_is_many_units_of_work(spark):
    made = smoothing._segments(spark.createDataFrame(track(1, 4000, 9), KIND), DEFAULT, 512)
    assert made.count() > 50 and made.where("size(rows) > 512").isEmpty()


@pytest.mark.parametrize("max_gap", [1, 2, 6, 50])
@pytest.mark.parametrize("hidden", [0.02, 0.1, 0.5])
def test_clusters_fill_as_the_whole_track_does(spark, max_gap, hidden):
    tracks = {m: track(m, 400, 10 + m, hidden) for m in (1, 2)} | {3: track(3, 200, 20, hidden, long_gaps=False), 4: [(4, i, None, None, 0.5) for i in range(30)]}
    df = spark.createDataFrame([r for rows in tracks.values() for r in rows], KIND).repartition(5)
    got = by_match(smoothing.quadratic_fill(df, max_gap))
    for m, rows in tracks.items():
        of = lambda i: np.array([np.nan if r[i] is None else r[i] for r in rows], float)  # noqa: B023, E731
        whole = smoothing._quadratic(np.array([r[1] for r in rows]), of(2), of(3), of(4), max_gap, DEFAULT)
        want = [tuple(None if v != v else float(v) for v in p) for p in zip(*whole, strict=True)]
        assert len(got[m]) == len(want) and near(got[m], want), m


def test_an_endless_gap_reaches_no_cluster(spark):
    rows = [(1, i, 1.0 if i < 5 or i > 995 else None, 1.0, 0.5) for i in range(1000)]
    gaps = smoothing.short_gaps(spark.createDataFrame(rows, KIND), 6)
    assert smoothing.gap_clusters(gaps, 5).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], KIND)
    assert smoothing.kalman_smooth(df).collect() == [] and smoothing.quadratic_fill(df).collect() == []


@pytest.mark.parametrize("stretch", [8, 10**6])
def test_distances_in_stretches(spark, stretch):
    from rallyframe.operators import players

    rng, rows = random.Random(8), []
    for m, p in ((1, 0), (1, 1), (2, 0)):
        x, y = 5.0, 10.0
        for f in sorted(rng.sample(range(600), 150)):
            x, y = (rng.uniform(0, 10), rng.uniform(0, 20)) if rng.random() < 0.05 else (x + rng.uniform(-0.3, 0.3), y + rng.uniform(-0.3, 0.3))
            rows.append((m, p, f, rng.randint(0, 3), x if rng.random() > 0.02 else None, y))
    want = {}
    for m, p in ((1, 0), (1, 1), (2, 0)):
        own, total = sorted(r for r in rows if r[:2] == (m, p)), 0.0
        for a, b in zip(own, own[1:], strict=False):
            step = None if a[4] is None or b[4] is None else ((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2) ** 0.5
            total += step if step is not None and step < 5 else 0
        want[m, p] = total
    df = spark.createDataFrame(rows, "match_id long, player_id int, frame_idx long, det_seq int, foot_x_m double, foot_y_m double").repartition(3)
    got = {(r.match_id, r.player_id): r.distance_m for r in players.distances(df, stretch=stretch).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.006 for k in want)
