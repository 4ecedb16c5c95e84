import hashlib
import random

import numpy as np
import pytest

from rallyframe.llm import line_dedup

from .helpers import ODD, documents

LINE = "This line is Long enough to count as a key, surely"


def brute(rows):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    holds = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holds.setdefault(key(line), set()).add(i)
    gone = {k: max((x for x in v if x is not None), default=None) for k, v in holds.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or (gone[key(x)] == i and i is not None)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(3)
    common = [LINE, LINE.upper() + "\t", "  é" + "x" * 39, "é" * 39, "中" * 40 + " \r", "y" * 39, *["line %d " % i * 8 for i in range(30)]]
    out = list(ODD)
    for i in range(20, 80):
        own = [rng.choice(common) for _ in range(rng.randint(1, 6))] + ["only %d " % i * 9]
        rng.shuffle(own)
        out.append((i, "\n".join(own)))
    out += [(90, LINE + "\n" + LINE), (91, LINE), (91, LINE), (91, "other\n" + LINE), (None, LINE)]
    return out


@pytest.mark.parametrize("index_bytes", [line_dedup.INDEX_BYTES, 0])
def test_equals_brute_force(spark, index_bytes):
    df = documents(spark, rows()).withColumnRenamed("lang", "h").withColumnRenamed("source", "shard")
    got = line_dedup.dedup_lines(df, digests=True, index_bytes=index_bytes).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows())
    assert any(r.n_dropped for r in got)


@pytest.mark.parametrize("index_bytes", [line_dedup.INDEX_BYTES, 0])
def test_texts_and_other_columns(spark, index_bytes):
    df = documents(spark, [(i, f"{LINE}\nbody {i}") for i in range(6)])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, index_bytes=index_bytes).collect()}
    assert got[5].text == f"{LINE}\nbody 5" and got[2].text == "body 2" and got[2].lang == "en" and got[2].n_dropped == 1


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 30000):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        ph = line_dedup.PerfectHash.build(h)
        assert sorted(ph.rank(h).tolist()) == list(range(len(h)))


def test_shard_round_trip():
    h = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64))
    p = (h * np.uint64(7)).view(np.int64)
    shard = line_dedup.Shard.from_bytes(line_dedup.Shard.build(h, p, np.arange(len(h)), np.arange(len(h)) + 5).to_bytes())
    found, counts, largest = shard.probe(h, p)
    assert found.all() and (counts == np.arange(len(h))).all() and (largest == counts + 5).all()
    assert not shard.probe(h + np.uint64(1), p + 1)[0].any()


def test_keys_with_equal_hashes_are_told_apart():
    h = np.array([5, 9, 9, 9, 11, 11, 20], dtype=np.uint64)
    p = np.array([1, 2, 3, 4, 5, 6, 7])
    shard = line_dedup.Shard.from_bytes(line_dedup.Shard.build(h, p, np.arange(7) + 10, np.arange(7) + 100).to_bytes())
    found, counts, largest = shard.probe(h, p)
    assert found.all() and counts.tolist() == list(range(10, 17)) and largest.tolist() == list(range(100, 107))
    assert not shard.probe(np.array([9, 11, 5], dtype=np.uint64), np.array([9, 4, 2]))[0].any()


def test_a_line_of_very_many_documents_is_salted(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PROBES", 20)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    got = line_dedup.dedup_lines(documents(spark, rows()), digests=True, index_bytes=0).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows())


def test_empty_table(spark):
    assert line_dedup.dedup_lines(documents(spark, []), digests=True).count() == 0
