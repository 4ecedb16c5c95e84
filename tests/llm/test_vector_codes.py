"""op11 against plain Python, and its cases."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rallyframe.llm import vector_codes

KIND = "vec_id long, label int, embedding array<double>, extra string"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows: (vec_id, label, vector), all of one length; the same by loops over Python integers."""
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    each = len(kept[0][2]) // parts
    cut = [[v[p * each : (p + 1) * each] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        groups = [defaultdict(list) for _ in range(parts)]
        for c in cut:
            for p in range(parts):
                groups[p][nearest(p, c[p])[1]].append(c[p])
        for p in range(parts):
            for e, own in groups[p].items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, labels = [], Counter()
    for (i, label, _), c in zip(kept, cut, strict=True):
        best = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
        labels[label] += out[-1][2]
    return sorted(((i, code, error, labels[label], digest) for i, code, error, label in out), key=str)


def rows_of(n, seed, length=8, values=6):
    rng = random.Random(seed)
    return [(i, rng.choice([None, 1, 2, 3]), [rng.randint(-values, values) / values for _ in range(length)]) for i in range(n)]


def run(spark, rows, **settings):
    df = spark.createDataFrame([(i, label, v, "x") for i, label, v in rows], KIND)
    codes, codec = vector_codes.compress(df, **settings)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, codec.digest()) for r in codes.collect()), key=str)


def test_equals_loops_with_more_vectors_than_entries(spark):
    rows = rows_of(400, 1)
    assert run(spark, rows, entries=16) == brute(rows, entries=16)


def test_fewer_vectors_than_entries_and_repeated_rows(spark):
    rows = rows_of(20, 2) + rows_of(20, 2)[:5] + [(None, 1, [0.5] * 8), (None, 1, [0.25] * 8)]
    assert run(spark, rows) == brute(rows)


def test_heavy_parts_join_as_others_do(spark, monkeypatch):
    rows = rows_of(60, 3) + [(100 + i, 2, [0.5] * 8) for i in range(200)] + [(400 + i, None, [0.5] * 4 + [i / 90, 0.0, 0.0, 0.0]) for i in range(80)]
    monkeypatch.setattr(vector_codes, "HEAVY", 10)
    assert run(spark, rows, entries=8) == brute(rows, entries=8)


def test_dropped_and_uncoded_vectors(spark):
    bad = [(50, 1, None), (51, 1, [None] + [0.0] * 7), (52, 1, [math.nan] + [0.0] * 7), (53, 1, [math.inf] + [0.0] * 7), (54, 1, [-math.inf] * 8)]
    odd = [(60, 1, [1.0] * 4), (61, 7, [1e30] + [0.0] * 7), (62, None, [])]
    good = rows_of(30, 4)
    got = run(spark, good + bad + odd, entries=4)
    want = brute(good, entries=4)
    labels = {r[0]: r[3] for r in want}
    of_label = lambda label: next((labels[i] for i, own, _ in good if own == label), None)
    more = [(60, None, None, of_label(1), want[0][4]), (61, None, None, None, want[0][4]), (62, None, None, of_label(None), want[0][4])]
    assert got == sorted(want + more, key=str)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, None)]) == []


def test_floors_go_down_and_ties_to_the_lower_index():
    book = np.array([[0, 0], [2, 0], [0, 0]])
    assert [x.tolist() for x in vector_codes.nearest(np.array([[1, 0], [0, 0], [2, 0]]), book)] == [[0, 0, 1], [1, 0, 0]]
    large = np.array([[1 << 27, -(1 << 27)]])
    assert vector_codes.nearest(large, -large)[1].tolist() == [2 * (1 << 28) ** 2]
    assert vector_codes.nearest(large, large - 1)[1].tolist() == [2]


def test_more_entries_than_a_byte_has(spark):
    with pytest.raises(ValueError, match="byte"):
        run(spark, rows_of(3, 1), entries=257)
