"""Masks, outlines, courts and backgrounds against pixels and plain loops."""

import math
import random

import numpy as np
import pytest

from rallyframe.functions import geometry as g
from rallyframe.operators import background, courts, detection, masks

CELLS = "match_id long, frame_idx long, y long, x long"
RUNS = "match_id long, frame_idx long, y long, x0 long, x1 long"


def frames_of(n=6, height=20, width=30, seed=1):
    rng = np.random.default_rng(seed)
    out = {}
    for f in range(n):
        m = rng.random((height, width)) < rng.choice([0.2, 0.5, 0.8])
        m[3:9, 5:14] = True
        out[1, f] = m
    return out


def cells(spark, frames):
    return spark.createDataFrame([(m, f, int(y), int(x)) for (m, f), mask in frames.items() for y, x in np.argwhere(mask)], CELLS)


def runs(spark, frames):
    return spark.createDataFrame([(m, f, *r) for (m, f), mask in frames.items() for r in background.runs_of(mask)], RUNS)


def pixels(df, shape=(60, 80)):
    out = {}
    for r in df.collect():
        mask = out.setdefault((r.match_id, r.frame_idx), np.zeros(shape, bool))
        assert not mask[r.y + 10, r.x0 + 10 : r.x1 + 11].any()
        mask[r.y + 10, r.x0 + 10 : r.x1 + 11] = True
    return out


def padded(mask, shape=(60, 80)):
    out = np.zeros(shape, bool)
    out[10 : 10 + mask.shape[0], 10 : 10 + mask.shape[1]] = mask
    return out


def shifted(mask, dy, dx):
    return np.roll(np.roll(mask, dy, 0), dx, 1)


def same(got, want):
    return all(np.array_equal(got.get(k, np.zeros_like(w)), w) for k, w in want.items())


def test_runs_of_cells(spark):
    frames = frames_of()
    df = cells(spark, frames)
    assert same(pixels(masks.mask_runs(df.unionByName(df))), {k: padded(m) for k, m in frames.items()})


@pytest.mark.parametrize("element", [masks.SMALL_ELLIPSE, masks.ELLIPSE, masks.rectangle(3, 3), masks.rectangle(4, 1)])
def test_morphology(spark, element):
    frames = frames_of()
    offsets = [(dy, dx) for dy, a, b in element for dx in range(a, b + 1)]
    spread = lambda m: np.any([shifted(m, dy, dx) for dy, dx in offsets], axis=0)
    shrunk = lambda m: np.all([shifted(m, -dy, -dx) for dy, dx in offsets], axis=0)
    df, whole = runs(spark, frames), {k: padded(m) for k, m in frames.items()}
    for ours, plain in ((masks.dilate, spread), (masks.erode, shrunk), (masks.opened, lambda m: spread(shrunk(m))), (masks.closed, lambda m: shrunk(spread(m)))):
        assert same(pixels(ours(df, element)), {k: plain(m) for k, m in whole.items()})


def flood(mask):
    left, out = {(int(y), int(x)) for y, x in np.argwhere(mask)}, []
    while left:
        stack, own = [min(left)], set()
        left.discard(stack[0])
        while stack:
            y, x = stack.pop()
            own.add((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            stack += near
        out.append(own)
    return sorted(out, key=min)


def test_components(spark):
    frames = {(1, f): m for (_, f), m in frames_of(8, seed=3).items()} | {(2, 0): np.zeros((9, 9), bool), (2, 1): np.eye(9, dtype=bool)}
    got = {}
    for r in masks.components(runs(spark, frames)).collect():
        got.setdefault((r.match_id, r.frame_idx), {})[r.component] = (r.n_pixels, r.left, r.top, r.right, r.bottom)
    want = {k: {n: (len(c), min(x for _, x in c), min(y for y, _ in c), max(x for _, x in c), max(y for y, _ in c)) for n, c in enumerate(flood(m))} for k, m in frames.items() if m.any()}
    assert got == want


def test_outline_and_measures(spark):
    box = np.zeros((20, 20), bool)
    box[2:8, 3:14] = True
    box[4:6, 5:9] = False  # a hole is no outer border
    line, dot = np.zeros((20, 20), bool), np.zeros((20, 20), bool)
    line[5, 2:9] = True
    dot[7, 7] = True
    disc = np.hypot(*np.mgrid[-9:11, -9:11]) <= 7
    got = {r.frame_idx: r for r in masks.components(runs(spark, {(1, 0): box, (1, 1): line, (1, 2): dot, (1, 3): disc}), outlines=True).collect()}
    assert (got[0].area, got[0].perimeter, got[0].x, got[0].y) == (50.0, 30.0, 8.0, 4.5) and got[0].n_pixels == 58
    assert (got[1].area, got[1].perimeter) == (0.0, 12.0) and (got[2].area, got[2].perimeter, got[2].x, got[2].y) == (0.0, 0.0, 7.0, 7.0)
    assert len({(p.x, p.y) for p in got[0].points}) == len(got[0].points) == 30
    assert 4 * math.pi * got[3].area / got[3].perimeter**2 > 0.8 and (got[3].x, got[3].y) == (pytest.approx(9), pytest.approx(9))


def quad(corners, width, height):
    """The mask of a convex quadrilateral."""
    y, x = np.mgrid[0:height, 0:width]
    inside = np.ones((height, width), bool)
    for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1], strict=True):
        inside &= (c - a) * (y - b) - (d - b) * (x - a) >= 0
    return inside


PLANTED = [((60, 20), (180, 24), (230, 140), (20, 150)), ((50, 10), (200, 10), (200, 120), (50, 120)), ((100, 12), (220, 70), (130, 150), (15, 80))]


def test_planted_courts_are_found_within_a_pixel(spark):
    frames = {(m, 0): quad(list(c), 256, 160) for m, c in enumerate(PLANTED)} | {(9, 0): np.pad(np.ones((5, 5), bool), ((0, 155), (0, 251)))}
    found = courts.court_corners(runs(spark, frames), 256, 160)
    got = {}
    for r in found.collect():
        got.setdefault(r.match_id, []).append((r.x, r.y))
    assert set(got) == {0, 1, 2}
    for m, want in enumerate(PLANTED):
        assert all(min(math.dist(p, q) for q in got[m]) < 1.5 for p in want)
    videos = spark.createDataFrame([(m, 256, 160) for m in (0, 1, 2, 9)], "match_id long, width int, height int")
    made = {r.match_id: r for r in detection.calibrations(found, videos).collect()}
    assert [made[m].estimated for m in (0, 1, 2, 9)] == [False, False, True, True]  # two corners of the third are the same by their order
    want = np.array(g.fit_homography([(50.0, 10.0), (200.0, 10.0), (200.0, 120.0), (50.0, 120.0)]))
    assert np.allclose(np.array(made[1].homography) / made[1].homography[2][2], want / want[2, 2], atol=1e-3)


def test_courts_by_colour_take_the_smallest_box(spark):
    turned = quad([(100, 20), (180, 100), (130, 150), (50, 70)], 256, 160)
    turned[60:70, 90:100] = False
    got = [(r.x, r.y) for r in courts.court_corners(runs(spark, {(1, 0): turned}), 256, 160, box_only=0.15).collect()]
    assert all(min(math.dist(p, q) for q in got) < 2 for p in ((100, 20), (180, 100), (130, 150), (50, 70)))
    assert courts.court_corners(runs(spark, {(1, 0): turned}), 256, 160, box_only=0.9).collect() == []


def test_straight_lines_are_voted_for(spark):
    mask = np.zeros((160, 256), bool)
    mask[40, 20:200] = True
    mask[10:150, 77] = True
    for i in range(100):
        mask[20 + i, 100 + i] = True
    found = courts.lines(courts.line_votes(cells(spark, {(1, 0): mask})), 80).collect()
    assert {(r.angle, r.offset) for r in found if r.votes >= 90} >= {(90, 40), (0, 77), (135, -57)}
    court = quad(list(PLANTED[0]), 256, 160)
    strong = courts.lines(courts.line_votes(courts.edge_cells(runs(spark, {(1, 0): court}))), 60)
    assert courts.gated(courts.court_corners(runs(spark, {(1, 0): court}), 256, 160), strong).count() == 4
    assert courts.gated(courts.court_corners(runs(spark, {(1, 0): court}), 256, 160), strong.limit(3)).count() == 0


def plain_mixture(values, rules):
    """One pixel through time by scalars: whether it is foreground in each frame."""
    modes, out = [], []
    for seen, x in enumerate(values, 1):
        rate, below, is_background, hit = 1 / min(2 * seen, rules.history), 0.0, False, None
        for k, (w, m, v) in enumerate(modes):
            if below < rules.ratio and (x - m) ** 2 < rules.far * v:
                is_background = True
            if hit is None and (x - m) ** 2 < rules.near * v:
                hit = k
            below += w
        out.append(not is_background)
        for k, mode in enumerate(modes):
            w, m, v = mode
            w -= rate * (w + rules.prior)
            if k == hit:
                w += rate
                d = x - m
                m, v = m + rate / w * d, min(max(v + rate / w * (d * d - v), rules.least), rules.most)
            mode[:] = w, m, v
        modes = [mode for mode in modes if mode[0] > 0]
        if hit is None:
            if len(modes) == rules.modes:
                modes.pop()
            modes.append([rate, float(x), rules.first])
        total = sum(mode[0] for mode in modes)
        for mode in modes:
            mode[0] /= total
        modes.sort(key=lambda mode: -mode[0])
    return out


def film(n=90, height=24, width=32, seed=1):
    """Noise on a fixed picture, and a bright ball that crosses it from frame 40 on."""
    rng = np.random.default_rng(seed)
    still = rng.integers(40, 120, (height, width))
    out, balls = [], {}
    for f in range(n):
        frame = np.clip(still + rng.normal(0, 2, still.shape), 0, 255)
        if f >= 40:
            x, y = 2 + (f - 40) % 26, 5 + (f - 40) // 4
            frame[y : y + 4, x : x + 4] = 240
            balls[f] = (x, y)
        out.append(frame.astype(np.uint8))
    return out, balls


def tiles(spark, frames, size=8):
    rows = [(1, x // size, y // size, f, bytes(frame[y : y + size, x : x + size].tobytes())) for f, frame in enumerate(frames) for y in range(0, frame.shape[0], size) for x in range(0, frame.shape[1], size)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "match_id long, tile_x long, tile_y long, frame_idx long, pixels binary").repartition(4)


def test_foreground_equals_a_plain_loop_and_finds_the_ball(spark):
    frames, balls = film()
    df = background.foreground(tiles(spark, frames), 8, 8, warm_up=20)
    got = np.zeros((len(frames), 24, 32), bool)
    for r in df.collect():
        got[r.frame_idx, r.y, r.x0 : r.x1 + 1] = True
    stack = np.stack(frames)
    for y, x in [(0, 0), (5, 7), (8, 16), (10, 12), (13, 3), (23, 31)]:
        values = [*stack[:20, y, x].astype(float), *stack[:, y, x].astype(float)]
        assert got[:, y, x].tolist() == plain_mixture(values, background.MixtureRules())[20:]
    for f, (x, y) in balls.items():
        assert got[f, y : y + 4, x : x + 4].mean() > 0.6
    assert got[:40].mean() < 0.01


def test_a_ball_from_tiles_to_candidates(spark):
    frames, balls = film()
    moving = background.foreground(tiles(spark, frames), 8, 8, warm_up=20)
    clean = masks.closed(masks.opened(moving, masks.SMALL_ELLIPSE), masks.ELLIPSE)
    lines = spark.createDataFrame([(1, f, y, bytes(frame[y].tobytes())) for f, frame in enumerate(frames) for y in range(24)], "match_id long, frame_idx long, y long, pixels binary")
    found = masks.candidates(masks.components(clean), lines)
    every = spark.createDataFrame([(1, f) for f in range(len(frames))], "match_id long, frame_idx long")
    best = {r.frame_idx: r for r in detection.best_candidates(every, found).collect()}
    hits = [f for f, (x, y) in balls.items() if best[f].x is not None and math.dist((best[f].x, best[f].y), (x + 1.5, y + 1.5)) < 3]
    assert len(hits) > 0.7 * len(balls) and len(best) == len(frames)


def test_empty(spark):
    none = spark.createDataFrame([], RUNS)
    assert masks.closed(none, masks.ELLIPSE).collect() == masks.components(none).collect() == courts.court_corners(none, 9, 9).collect() == []
    assert courts.lines(courts.line_votes(spark.createDataFrame([], CELLS))).collect() == []


def test_votes_are_counted_in_a_frame_and_not_shuffled(spark, monkeypatch):
    from math import cos, floor, pi, sin

    import numpy as np

    mask = np.random.default_rng(5).random((30, 40)) < 0.3
    at = [(int(x), int(y)) for y, x in zip(*np.nonzero(mask), strict=True)]
    want = {}
    for x, y in at:
        for k in range(180):
            line = k, floor(round(x * cos(k * pi / 180) + y * sin(k * pi / 180), 9) + 0.5)
            want[line] = want.get(line, 0) + 1
    strong = {line: n for line, n in want.items() if n >= 12}
    votes = courts.line_votes(cells(spark, {(1, 0): mask, (2, 5): np.zeros((3, 3), bool)}), least=12)
    assert {(r.angle, r.offset): r.votes for r in votes.collect()} == strong and 0 < len(strong) < len(want)
    assert votes._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # of cells by frame
    monkeypatch.setattr(courts, "CELLS_AT_ONCE", 100)
    x, y = (np.array(v) for v in zip(*at, strict=True))
    for shift in (0, 20_000):  # the second has too many offsets for an array
        angle, offset, n = courts._frame_votes(x + shift, y, 180, 12)
        if not shift:
            assert dict(zip(zip(angle.tolist(), offset.tolist(), strict=True), n.tolist(), strict=True)) == strong
        assert sorted(n[angle == 90].tolist()) == sorted(v for (k, _), v in strong.items() if k == 90)
