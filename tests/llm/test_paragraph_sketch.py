import hashlib
import random
import tracemalloc

import numpy as np
import xxhash

from rallyframe.llm import paragraph_sketch as p

from .helpers import ODD, documents


def text(rng, lines):
    return "\n".join(" ".join("w%d" % rng.randrange(500) for _ in range(rng.randint(3, 60))) + "." for _ in range(lines))


def signed_hash(t):
    h = xxhash.xxh64_intdigest(t.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -signed_hash(r[1])))
    out = []
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]

        def like(a, b):
            a, b = set(p.digests(a).tolist()), set(p.digests(b).tolist())
            return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0

        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(t, edited), 9), round(like(t, after), 9)))
    return out


def rows():
    rng = random.Random(6)
    out = list(ODD)
    for i in range(300):
        out.append((100 + 7 * i, text(rng, rng.randint(0, 12))))
    for i in range(5):
        out.append((5000 + i, text(random.Random(1), 400)))
    return out


def test_equals_brute_force(spark):
    df = documents(spark, rows()).withColumnRenamed("lang", "part").withColumnRenamed("source", "edge")
    got = p.fingerprint_versions(df).collect()
    have = sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str)
    assert have == sorted(brute(rows()), key=str)
    by_text = {}
    texts = dict(rows()[10:])
    for r in got:
        if r.doc_id in texts:
            by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)


def test_peeling_recovers_paragraphs():
    rng = random.Random(2)
    for n in (0, 1, 5, 60, 3000):
        a = ["same %d" % i for i in range(200)] + ["old %d" % rng.random().__hash__() for _ in range(n)]
        b = ["same %d" % i for i in range(200)] + ["new %d" % rng.random().__hash__() for _ in range(n // 2)]
        old, new = p.differing_paragraphs("\n".join(a), "\n".join(b))
        assert old == set(p.digests("\n".join(a)).tolist()) - set(p.digests("\n".join(b)).tolist())
        assert new == set(p.digests("\n".join(b)).tolist()) - set(p.digests("\n".join(a)).tolist())


def test_small_sketches_stall_and_grow():
    sets = [np.arange(1, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.zeros(0, dtype=np.uint64)]
    small = p.sketch(sets, np.arange(2), p.BASE)
    assert not small.minus(small, np.array([0]), np.array([1])).peel()[3].any()
    assert p.differences(sets, small, np.array([0]), np.array([1]))[0].tolist() == [499]


def test_a_cell_that_lies_ends():
    h = np.uint64(0x1234567890ABCDEF)
    own = {int(c[0]) for c in p._cells(np.array([h]), np.array([0]), p.BASE)}
    for cell in set(range(3 * p.BASE)) - own:
        wrong = p.Sketches(1, p.BASE)
        wrong.count[cell], wrong.keys[cell], wrong.checks[cell] = 1, h, p._checks(np.array([h]))[0]
        rows, _, _, empty = wrong.peel()
        assert not len(rows) and not empty.any()


def test_difference_is_estimated():
    rng = np.random.default_rng(4)
    common = rng.integers(1, 1 << 62, 5000, dtype=np.uint64)
    sets = [common, np.concatenate([common, rng.integers(1, 1 << 62, 3, dtype=np.uint64)]), rng.integers(1, 1 << 62, 5000, dtype=np.uint64)]
    got = p.first_sizes(sets, np.array([0, 0, 0]), np.array([0, 1, 2]))
    assert got[0] == got[1] == p.BASE and 3 * got[2] >= 10_000


def test_memory_of_long_texts():
    rng = np.random.default_rng(3)
    sets = [rng.integers(1, 1 << 62, 3000, dtype=np.uint64) for _ in range(201)]
    base = p.sketch(sets, np.arange(201), p.BASE)
    left = np.concatenate([np.arange(200), np.arange(200)])
    right = np.concatenate([np.arange(1, 201), np.zeros(200, dtype=np.int64)])
    tracemalloc.start()
    count, cells, _ = p.differences(sets, base, left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count.tolist() == [6000 if a != b else 0 for a, b in zip(left, right, strict=True)]
    assert peak < 150 << 20 and set(cells.tolist()) <= {3 * p.BASE, 3 * p.BASE * p.GROW**4, 3 * p.BASE * p.GROW**5}


def test_few_rows(spark):
    assert p.fingerprint_versions(documents(spark, [])).count() == 0
    only = p.fingerprint_versions(documents(spark, [(1, "abcdef")])).collect()
    assert [(r.n_chars, r.edited_sha256, r.near_next) for r in only] == [(6, hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
