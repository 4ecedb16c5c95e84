"""Streams against the whole tables, however they are cut, out of order, and begun again."""

import random

import pandas as pd
import pyarrow as pa
import pytest

from rallyframe import schemas
from rallyframe.functions.geometry import literal_homography
from rallyframe.operators import events as ev
from rallyframe.operators import joins, kinematics, smoothing, tracking
from rallyframe.sources.adapters import HOMOGRAPHY
from rallyframe.streaming import live

from .test_smoothing import KIND, track
from .test_tracking import KIND as BOXES
from .test_tracking import walkers

EVENTS = "match_id long, type string, frame_idx long, x double, y double, track_id int, confidence double"


class Source:
    """A folder of files that a stream reads one at a time, and a table that it writes."""

    def __init__(self, spark, path, kind):
        self.spark, self.path, self.kind, self.n = spark, path, kind, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.kind).coalesce(1).write.parquet(f"{self.path}/in/{self.n:04d}")

    def stream(self):
        return self.spark.readStream.schema(self.kind).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in/*")


def run(out, path):
    query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return query


def pieces(rows, n, seed=0, late=30, frame=1):
    """In n files, each row up to `late` frames out of place."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[frame] + rng.uniform(0, late))
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


def result(spark, path, columns):
    return [r for r in plain(tuple(r) for r in spark.read.parquet(f"{path}/out").select(*columns).collect()) if r[0] != 99]


TRACKS = [r for m in (1, 2) for r in track(m, 150, m)] + [(3, i, None, None, 0.2) for i in range(30)] + track(3, 40, 3, start=30)
FAR = 10**6


@pytest.mark.parametrize("cuts", [1, 4])
def test_kalman_equals_the_table(spark, tmp_path, cuts):
    source = Source(spark, tmp_path, KIND)
    for part in pieces(TRACKS, cuts):
        source.add(part)
    source.add([(99, FAR, 1.0, 1.0, 1.0)])
    run(live.live_kalman(source.stream()), tmp_path)
    names = ["match_id", "frame_idx", "x_px", "y_px", "confidence"]
    assert result(spark, tmp_path, names) == plain(tuple(r) for r in smoothing.kalman_smooth(spark.createDataFrame(TRACKS, KIND)).select(*names).collect())


def some_events(seed=5):
    rng, frame, rows = random.Random(seed), 0, []
    for i in range(300):
        frame += rng.choice([0, 1, 3, 5, 9, 20])
        rows.append((i % 2, rng.choice(["hit", "bounce"]), frame, float(i), 0.0, rng.choice([None, 1, 2]), 0.8))
    return rows


def test_dedup_goes_on_after_a_restart(spark, tmp_path):
    rows = some_events()
    source = Source(spark, tmp_path, EVENTS)
    first, *rest = pieces(rows, 3, frame=2)
    source.add(first)
    run(live.live_dedup(source.stream()), tmp_path)
    before = len(result(spark, tmp_path, ["match_id"]))
    for part in rest:
        source.add(part)
    source.add([(99, "hit", FAR, 0.0, 0.0, 1, 1.0)])
    run(live.live_dedup(source.stream()), tmp_path)
    names = ["match_id", "type", "frame_idx", "x", "track_id"]
    want = plain(tuple(r) for r in ev.dedup_events(spark.createDataFrame(rows, EVENTS)).select(*names).collect())
    assert 0 < before < len(want) and result(spark, tmp_path, names) == want


def test_tracks_keep_their_ids_over_batches(spark, tmp_path):
    rows = walkers(1, n=120) + walkers(2, n=80, seed=7)
    source = Source(spark, tmp_path, BOXES)
    for part in pieces(rows, 3, late=20):
        source.add(part)
    source.add([(99, FAR, 0, 0.0, 0.0, 1.0, 1.0, 1.0)])
    run(live.live_tracks(source.stream()), tmp_path)
    names = ["match_id", "frame_idx", "det_seq", "track_id"]
    assert result(spark, tmp_path, names) == plain(tuple(r) for r in tracking.track_boxes(spark.createDataFrame(rows, BOXES)).select(*names).collect())


def test_steps_then_hits_over_streams(spark, tmp_path):
    ball = [r for m in (1, 2) for r in track(m, 200, 40 + m, hidden=0.05)]
    frames = sorted({(r[0], r[1]) for r in ball})
    rng = random.Random(2)
    players = []
    for m, f in frames:
        for k in range(3):
            if rng.random() < 0.5:
                players.append((m, f + rng.choice([-3, 0, 2]), k + 1, k, rng.uniform(0, 1280), rng.uniform(0, 720), rng.uniform(0, 10), rng.uniform(0, 20)))
    homography = literal_homography(HOMOGRAPHY)
    steps = kinematics.differences(spark.createDataFrame(ball, KIND), homography)
    source = Source(spark, tmp_path / "steps", KIND)
    for part in pieces(ball, 3):
        source.add(part)
    source.add([(99, FAR, 1.0, 1.0, 1.0)])
    run(live.live_steps(source.stream()), tmp_path / "steps")
    names = ["match_id", "frame_idx", "x", "y", "vx0", "vx1", "vy0", "vy1"]
    inner = kinematics.enough_visible(steps).where("vx0 is not null and vx1 is not null")
    assert result(spark, tmp_path / "steps", names) == plain(tuple(r) for r in inner.select(*names).collect())

    peaks = kinematics.acceleration_peaks(steps).select("match_id", "frame_idx", "x", "y", "cx", "cy")
    peak_rows = [tuple(r) for r in peaks.collect()]
    a = Source(spark, tmp_path / "peaks", peaks.schema.simpleString()[7:-1].replace(":", " "))
    b = Source(spark, tmp_path / "players", schemas.PLAYERS)
    for part, others in zip(pieces(peak_rows, 3), pieces(players, 3, seed=1), strict=True):
        a.add(part)
        b.add(others)
    for frame in (FAR, 2 * FAR):
        a.add([(99, frame, 0.0, 0.0, 0.0, 0.0)])
        b.add([(99, frame, 1, 0, 0.0, 0.0, 0.0, 0.0)])
    last = run(live.live_hits(a.stream(), b.stream(), calibrated=False), tmp_path / "hits")
    columns = ["match_id", "frame_idx", "type", "x", "y", "track_id"]
    want = plain(tuple(r) for r in joins.hits(peaks, spark.createDataFrame(players, schemas.PLAYERS), calibrated=False).select(*columns).collect())
    assert want and result(spark, tmp_path / "hits", columns) == want
    kept = last.lastProgress["stateOperators"]
    assert sum(o["numRowsTotal"] for o in kept) < 20  # all but the last rows have left


def test_what_is_too_late_is_dropped(spark, tmp_path):
    source = Source(spark, tmp_path, EVENTS)
    source.add([(1, "hit", 1000, 0.0, 0.0, 1, 1.0)])
    source.add([(1, "hit", 2000, 0.0, 0.0, 1, 1.0)])
    source.add([(1, "hit", 500, 0.0, 0.0, 1, 1.0), (1, "hit", 2100, 0.0, 0.0, 1, 1.0)])
    source.add([(99, "hit", FAR, 0.0, 0.0, 1, 1.0)])
    run(live.live_dedup(source.stream()), tmp_path)
    assert [r[0] for r in result(spark, tmp_path, ["frame_idx"])] == [1000, 2000, 2100]


def test_rows_wait_packed_and_are_stepped_over_in_pieces(monkeypatch):
    import pandas as pd

    class Value:
        def __init__(self):
            self.v = []

        def appendValue(self, v):
            self.v.append(v)

        put = lambda self, v: setattr(self, "v", list(v))
        get = lambda self: iter(self.v)
        clear = lambda self: setattr(self, "v", [])

    class Handle:
        timers: list = []
        getListState = lambda self, *a: Value()
        listTimers = lambda self: iter(self.timers)
        registerTimer = lambda self, t: self.timers.append(t)
        deleteTimer = lambda self, t: self.timers.remove(t)

        def getValueState(self, *a):
            kept = type("Kept", (), {"v": None})()
            kept.exists, kept.get, kept.update = lambda: kept.v is not None, lambda: kept.v, lambda v: setattr(kept, "v", v)
            return kept

    class Counting(live.KalmanStepper):
        sizes: list = []

        def step(self, state, rows):
            self.sizes.append(len(rows))
            return super().step(state, rows)

    monkeypatch.setattr(live, "ROWS", 16)
    stepper = Counting()
    processor = live._Ordered(["match_id"], stepper)
    processor.init(Handle())
    rows = [r[1:] for r in track(1, 100, 1)]
    batches = [pd.DataFrame([(i, *r[1:]) for i, r in list(enumerate(rows))[a : a + 25]], columns=stepper.columns) for a in (75, 0, 50, 25)]
    assert list(processor.handleInputRows((1,), iter(batches), None)) == [] and Handle.timers == [1000]
    assert len(processor.waiting.v) == 4  # one value a batch
    out = []
    for now in (60_000, 10**9):
        at = type("At", (), {"getCurrentWatermarkInMs": lambda self, now=now: now})()
        out += [tuple(r) for part in processor.handleExpiredTimer((1,), at, None) for r in part.itertuples(index=False)]
    plain_ = live.KalmanStepper()
    want = plain_.step(plain_.begin(), [(i, *r[1:]) for i, r in enumerate(rows)])[1]
    assert plain(out) == plain((1, *r) for r in want) and max(stepper.sizes) <= 17 and processor.waiting.v == []


class Blocks:
    """The state of one key, and what is asked of it."""

    def __init__(self):
        self.map, self.asked, self.timers = {}, [], []

    class Value:
        v = None
        exists = lambda self: self.v is not None
        get = lambda self: self.v
        update = lambda self, v: setattr(self, "v", v)

    getMapState = lambda self, *a: self
    getValueState = lambda self, *a: self.Value()
    containsKey = lambda self, k: k in self.map
    updateValue = lambda self, k, v: self.map.__setitem__(k, v)
    removeKey = lambda self, k: self.map.pop(k)
    keys = lambda self: iter(list(self.map))
    listTimers = lambda self: iter(list(self.timers))
    registerTimer = lambda self, t: self.timers.append(t)
    deleteTimer = lambda self, t: self.timers.remove(t)

    def getValue(self, k):
        self.asked.append(k[0])
        return self.map[k]


@pytest.mark.parametrize("stepper", [live.KalmanStepper(), live.StepsStepper()])
def test_packed_rows_wait_by_stretches_and_are_read_one_at_a_time(spark, monkeypatch, stepper):
    monkeypatch.setattr(live, "BLOCK", 64)
    rows = [(i, *r[2:]) for i, r in enumerate(track(1, 400, 1))][5:]
    names = list(stepper.columns)
    table = pd.DataFrame(rows, columns=["frame_idx", "x_px", "y_px", "confidence"])[names]

    def packs(part):
        batch = pa.RecordBatch.from_pandas(part.assign(match_id=1)[["match_id", *names]], preserve_index=False)
        return pd.concat([b.to_pandas() for b in live._packs(iter([batch]), ["match_id"], stepper)])

    at = lambda now: type("At", (), {"getCurrentWatermarkInMs": lambda self: now})()
    kept, processor, out = Blocks(), live._Blocks(["match_id"], stepper), []
    processor.init(kept)
    shuffled = table.sample(frac=1, random_state=4)
    for part in (shuffled[:200], shuffled[200:]):
        given = packs(part)
        assert len(given) == part["frame_idx"].floordiv(64).nunique()  # one row a stretch, not one a frame
        assert list(processor.handleInputRows((1,), iter([given]), at(0))) == []
    assert kept.timers == [6000] and sorted(kept.map) == [(b,) for b in range(7)]
    for now, left, timer in ((100_000, [1, 2, 3, 4, 5, 6], 101_000), (10**9, [], None)):
        kept.asked, kept.timers = [], []
        for frame in processor.handleExpiredTimer((1,), at(now), None):
            out += [tuple(None if v != v else v for v in r) for r in frame.itertuples(index=False)]
            assert kept.asked[-1] - int(frame["frame_idx"].max()) // 64 <= 1  # no stretch is read before it is needed
        assert sorted(k[0] for k in kept.map) == left and kept.timers == ([timer] if timer else [])
        assert now > 100_000 or kept.asked == [0, 1]  # later stretches are not read
    want = stepper.step(stepper.begin(), [tuple(None if v != v else v for v in r) for r in table.itertuples(index=False)])[1]
    assert plain(out) == plain((1, *r) for r in want)


def test_late_rows_of_a_pack_are_dropped(spark, tmp_path):
    source = Source(spark, tmp_path, KIND)
    for frames in ([1000], [2000], [500, 2100], [1990, 2200]):
        source.add([(1, f, 1.0, 1.0, 0.5) for f in frames])
    source.add([(99, FAR, 1.0, 1.0, 1.0)])
    run(live.live_kalman(source.stream()), tmp_path)
    assert [r[0] for r in result(spark, tmp_path, ["frame_idx"])] == [1000, 1990, 2000, 2100, 2200]


def test_columns_keep_whole_frames_and_every_row():
    import numpy as np

    stepper, far = live.KalmanStepper(max_gap=2), 2**53 + 1  # beyond what a double can tell apart
    frame, nan = np.arange(far, far + 6), np.array([np.nan] * 3)
    state, early = stepper.step_columns(stepper.begin(), [frame[:3], nan, nan, np.full(3, 0.5)])
    state, late = stepper.step_columns(state, [frame[3:], *(np.array([1.0, 2.0, np.nan]) for _ in range(2)), np.full(3, 0.5)])
    assert early[0].tolist() == [far + 2] and late[0].tolist() == [far, far + 1, far + 3, far + 4, far + 5]
    assert late[3].tolist() == [0.3, 0.3, 0.5, 0.5, 0.3]
