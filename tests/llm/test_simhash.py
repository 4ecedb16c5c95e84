import random

import numpy as np
import pytest
import xxhash

from rallyframe.llm import simhash

from .helpers import ODD, documents


def brute_print(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, budget):
    """Smallest id reachable, for (id, key) pairs."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= budget and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_equals_brute_force(budget):
    rng = random.Random(budget)
    for spread in (20, 64):
        base = [rng.getrandbits(64) for _ in range(20)]
        keys = []
        for _ in range(400):
            k = rng.choice(base)
            for _ in range(rng.randint(0, 5)):
                k ^= 1 << rng.randrange(spread)
            keys.append(k)
        keys = np.sort(np.array(keys, dtype=np.uint64))
        root = simhash.TrieJoin(keys, budget).run(np.array([0]), np.array([len(keys)]), 0).root
        whole = simhash.Components(len(keys))
        for i in range(len(keys)):
            j = np.flatnonzero(np.bitwise_count(keys ^ keys[i]) <= budget)
            whole.connect(np.full(len(j), i), j)
        assert (root == whole.root).all()


def near_texts():
    rng = random.Random(5)
    words = ["w%d" % rng.randrange(3000) for _ in range(900)]
    rows = []
    for i in range(60):
        own = list(words) if i % 2 else ["v%d" % rng.randrange(3000) for _ in range(300)]
        for _ in range(i % 5):
            own[rng.randrange(len(own))] = "x%d" % rng.randrange(99)
        rows.append((100 + i, " ".join(own)))
    return rows


def test_components_equal_brute_force(spark):
    rows = [*ODD, (None, near_texts()[1][1]), (100, "far away"), (7, near_texts()[4][1]), *near_texts()]
    df = documents(spark, rows).withColumnRenamed("lang", "node").withColumnRenamed("source", "key")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicate_components(df).collect()}
    prints = sorted(((i, brute_print(t)) for i, t in rows), key=lambda p: (p[0] is None, p))
    label = brute_components(prints, 2)
    assert got == {(i, f"{k:016x}", prints[label[n]][0]) for n, (i, k) in enumerate(prints)}
    assert len({c for _, _, c in got}) < len({k for _, k, _ in got})


def components(spark, monkeypatch, keys):
    """component_id by row, for rows of (doc_id, fingerprint)."""
    prints = spark.createDataFrame([(i, simhash._signed(k)) for i, k in keys], "doc_id long, key long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: prints)
    return {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in simhash.near_duplicate_components(documents(spark, [])).collect()}


def test_a_row_without_an_id_joins_others(spark, monkeypatch):
    got = components(spark, monkeypatch, [(1, 0b0000), (None, 0b0011), (2, 0b1111), (None, 255 << 40)])
    assert got == {(1, 0b0000): 1, (None, 0b0011): 1, (2, 0b1111): 1, (None, 255 << 40): None}


def test_texts_with_one_id_stay_apart(spark, monkeypatch):
    far = 255 << 40
    got = components(spark, monkeypatch, [(5, 0), (5, far), (7, 1), (9, far ^ 1)])
    assert got == {(5, 0): 5, (5, far): 5, (7, 1): 5, (9, far ^ 1): 5}
    got = components(spark, monkeypatch, [(5, 0), (5, far), (3, 1), (9, far ^ 1)])
    assert got == {(5, 0): 3, (5, far): 5, (3, 1): 3, (9, far ^ 1): 5}


def test_subtrees_in_small_steps(spark, monkeypatch):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    keys = {k ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for k in base for _ in range(15)} | {k << 20 & (1 << 64) - 1 for k in range(300)}
    nodes = spark.createDataFrame([(i, simhash._signed(k)) for i, k in enumerate(sorted(keys))], "node long, key long")
    whole = sorted(map(tuple, simhash.merge_memberships(simhash.trie_memberships(nodes, 2)).collect()))
    monkeypatch.setattr(simhash, "SUBTREE_ROWS", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, simhash.merge_memberships(simhash.trie_memberships(nodes, 2)).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    assert simhash.near_duplicate_components(documents(spark, [])).count() == 0


def test_long_chain_is_one_component(spark):
    keys = [0]
    for i in range(40):
        keys.append(keys[-1] ^ (1 << (i % 64)) ^ (1 << ((i * 7 + 3) % 64)))
    nodes = spark.createDataFrame([(i, simhash._signed(k)) for i, k in enumerate(dict.fromkeys(keys))], "node long, key long")
    labels = simhash.merge_memberships(simhash.trie_memberships(nodes, 2)).collect()
    assert {r.label for r in labels} == {0} and len(labels) == nodes.count()
