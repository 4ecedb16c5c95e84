"""Assignment and tracks against brute force."""

import itertools
import random

import numpy as np
import pytest

from rallyframe.operators import tracking
from rallyframe.operators.tracking import TrackRules, TrackStepper

KIND = "match_id long, frame_idx long, det_seq int, x1 double, y1 double, x2 double, y2 double, confidence double"


def test_assignment_is_the_best_of_all():
    rng = random.Random(4)
    for _ in range(400):
        n, m = rng.randint(0, 5), rng.randint(0, 5)
        gain = np.array([[rng.choice([0.0, rng.random(), 0.5]) for _ in range(m)] for _ in range(n)]).reshape(n, m)
        got = tracking.assign(gain)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and all(gain[p] > 0 for p in got)
        short, long_ = min(n, m), max(n, m)
        wide = gain if n <= m else gain.T
        best = max((sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(long_), short)), default=0.0)
        assert sum(gain[p] for p in got) == pytest.approx(best)


def test_overlap():
    a = np.array([[0, 0, 2, 2], [0, 0, 0, 5]], float)
    assert tracking.overlaps(a, np.array([[1, 1, 3, 3], [0, 0, 2, 2], [5, 5, 6, 6.0]])).tolist() == [[1 / 7, 1, 0], [0, 0, 0]]


def walkers(match_id=1, n=200, people=4, seed=1, gone=0.1):
    """People who walk, cross and are sometimes missed; in shuffled order within a frame. det_seq tells who it is."""
    rng = random.Random(seed)
    place = [[rng.uniform(100, 1100), 200.0 + 120 * p, rng.choice([-4, -2, 3, 5]), rng.uniform(-0.5, 0.5)] for p in range(people)]
    rows = []
    for f in range(n):
        seen = []
        for p, s in enumerate(place):
            s[0], s[1] = s[0] + s[2], s[1] + s[3]
            if not 0 < s[0] < 1200:
                s[2] = -s[2]
            if rng.random() > gone:
                seen.append((match_id, f, p, s[0], s[1], s[0] + 60, s[1] + 150, rng.uniform(0.4, 1)))
        rng.shuffle(seen)
        rows += seen
    return rows


def tracks_of(df):
    return sorted((r.match_id, r.frame_idx, r.det_seq, r.track_id) for r in df.collect())


def test_people_keep_their_track(spark):
    rows = walkers(1) + walkers(2, people=2, seed=2)
    random.Random(1).shuffle(rows)
    got = tracks_of(tracking.track_boxes(spark.createDataFrame(rows, KIND).repartition(5)))
    assert len(got) == len(rows)
    for m, people in ((1, 4), (2, 2)):
        assert len({(p, t) for match, _, p, t in got if match == m}) == people


def test_cut_anywhere_between_frames():
    rows = [r[1:] for r in sorted(walkers(1, n=60))]
    whole = TrackStepper().step(TrackStepper().begin(), rows)[1]
    for size in (1, 7):
        state, out = TrackStepper().begin(), []
        for f in range(0, 60, size):
            state, found = TrackStepper().step(state, [r for r in rows if f <= r[0] < f + size])
            out += found
        assert out == whole


def one(frame, x, confidence=0.9, seq=0):
    return (frame, seq, float(x), 0.0, float(x) + 10, 20.0, confidence)


def test_births_deaths_and_faint_detections():
    rules = TrackRules(patience=5)
    step = lambda rows: [r[2] for r in TrackStepper(rules).step(TrackStepper(rules).begin(), rows)[1]]
    assert step([one(0, 0), one(1, 1), one(6, 3)]) == [1, 1, 1]
    assert step([one(0, 0), one(1, 0), one(7, 0)]) == [1, 1, 2]  # gone for more than five frames
    assert step([one(0, 0, 0.2), one(1, 0), one(2, 1, 0.2), one(3, 1, 0.05)]) == [1, 1]  # a faint one begins nothing
    assert step([one(0, 0), one(1, 500)]) == [1, 2]
    assert step([one(0, 0), (1, 0, None, 0.0, 1.0, 1.0, 0.9), one(2, 0)]) == [1, 1]


def test_speed_carries_over_a_gap():
    rows = [one(f, 2 * f) for f in range(6)] + [one(f, 2 * f) for f in range(10, 14)]
    assert {r[2] for r in TrackStepper().step(TrackStepper().begin(), rows)[1]} == {1}


def test_empty(spark):
    assert tracking.track_boxes(spark.createDataFrame([], KIND)).collect() == []


def test_islands_are_worked_on_apart_and_numbered_on(spark):
    from pyspark.sql import functions as F

    from rallyframe.operators.ordered import islands

    rows = [(m, f + 300 * i, *r[2:]) for m in (1, 2) for i in range(4) for r in walkers() for f in [r[1]]]
    df = spark.createDataFrame(rows, KIND)
    found = islands(df, ["match_id"], 30)
    ends = sorted((r["min"], r["max"]) for r in found.where("match_id = 1").groupBy("island").agg(F.min("frame_idx").alias("min"), F.max("frame_idx").alias("max")).collect())
    assert len(ends) > 1 and all(b[0] - a[1] > 30 for a, b in zip(ends, ends[1:], strict=False))
    columns = ["match_id", *tracking.TrackStepper.columns]
    want = []
    for m in (1, 2):
        stepper = tracking.TrackStepper()
        own = sorted(tuple(r[c] for c in columns[1:]) for r in df.where(f"match_id = {m}").collect())
        want += [(m, *r) for r in stepper.step(stepper.begin(), own)[1]]
    assert sorted(tuple(r) for r in tracking.track_boxes(df).select("match_id", "frame_idx", "det_seq", "track_id").collect()) == sorted(want)
