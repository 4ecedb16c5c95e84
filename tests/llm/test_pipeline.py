import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from rallyframe.llm import simhash  # noqa: E402

from .helpers import ODD, documents, save  # noqa: E402


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_of_edited_texts(spark):
    rng = random.Random(9)
    rows, family = [], {}
    for f in range(40):
        words = ["w%d" % rng.randrange(400) for _ in range(rng.randint(60, 400))]
        for c in range(rng.randint(1, 4)):
            own = list(words)
            for _ in range(c * len(own) // 120):
                own[rng.randrange(len(own))] = "x%d" % rng.randrange(50)
            rows.append((f * 10 + c, " ".join(own)))
            family[f * 10 + c] = f
    got = {r.doc_id: r.component_id for r in simhash.near_copies(documents(spark, rows)).collect()}
    text = dict(rows)
    for i in family:
        for j in family:
            if i < j and len(shingles(text[i]) & shingles(text[j])) >= 0.8 * len(shingles(text[i]) | shingles(text[j])):
                assert got[i] == got[j]
            if family[i] != family[j]:
                assert got[i] != got[j]


def copies(spark, pairs):
    """Which pairs of texts become one component."""
    rows = [(2 * i + k, text) for i, pair in enumerate(pairs) for k, text in enumerate(pair)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(documents(spark, rows)).collect()}
    return [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))]


def resemblance(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_copies_with_one_inserted_passage(spark):
    rng = random.Random(4)
    draw = lambda n: ["w%d" % rng.randrange(3000) for _ in range(n)]
    pairs = []
    for n in (160, 300, 800, 2000):
        for share in (0.05, 0.1, 0.15, 0.2):
            for at in (n, n // 3):
                words = draw(n)
                pairs.append((" ".join(words), " ".join(words[:at] + draw(int(n * share)) + words[at:])))
    pairs = [p for p in pairs if resemblance(*p) >= 0.8]
    assert len(pairs) >= 28 and all(copies(spark, pairs))


def test_less_similar_texts_stay_apart(spark):
    rng = random.Random(5)
    pairs = []
    while len(pairs) < 40:
        words = ["w%d" % rng.randrange(3000) for _ in range(400)]
        own = list(words)
        for at in rng.sample(range(400), rng.randint(10, 14)):
            own[at] = "x%d" % rng.randrange(50)
        pair = " ".join(words), " ".join(own)
        if 0.7 <= resemblance(*pair) < 0.8:
            pairs.append(pair)
    assert not any(copies(spark, pairs))


@pytest.mark.parametrize("size", [30, 300])
def test_groups_of_any_size_are_compared_alike(spark, size):
    """Copies of one text with some words changed: components by all pairs."""
    rng = random.Random(6)
    words = ["w%d" % rng.randrange(3000) for _ in range(300)]
    texts = []
    for i in range(size):
        own = list(words)
        for at in rng.sample(range(300), rng.randint(3, 9) if i % 3 else rng.randint(9, 14)):
            own[at] = "y%d" % rng.randrange(9000)
        texts.append(" ".join(own))
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_copies(documents(spark, list(enumerate(texts)))).collect())
    near = [[j for j in range(size) if resemblance(texts[i], texts[j]) >= 0.8] for i in range(size)]
    want = list(range(size))
    for _ in range(size):
        after = [min(want[j] for j in own) for own in near]
        if after == want:
            break
        want = after
    assert [c for _, c in got] == want and 1 < len(set(want)) < size


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_one_of_copies(documents(spark, ODD).withColumnRenamed("lang", "node").withColumnRenamed("source", "tie")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "5", "6", "7", "None"]
    assert set(kept[0].asDict()) == {"doc_id", "text", "node", "tie", "n_chars"}


def test_copies_without_or_with_one_id(spark):
    a, b, c = ("%s1 %s2 %s3 %s4 %s5 %s6 %s7" % ((x,) * 7) for x in "abc")
    rows = [(None, a), (None, a), (4, a), (None, b), (None, b + "."), (7, a), (7, c), (7, c), (8, c)]
    kept = simhash.keep_one_of_copies(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in kept) == [("4", "a"), ("7", "c"), ("None", "b")]


def test_empty_tables(spark, tmp_path):
    save(documents(spark, []), tmp_path)
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    save(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_pass_through(spark, tmp_path):
    names = ["__score", "score", "toxicity", "row", "id", "tie", "first", "n_dropped", "n_lines", "__text", "__gone", "ids"]
    docs = documents(spark, [*ODD, (50, "you idiot")])
    for n, name in enumerate(names):
        docs = docs.selectExpr("*", f"'{n}' as `{name}`")
    save(docs, tmp_path)
    save(spark.createDataFrame([(50, 1, 1), (5, 1, 0), (6, 0, None)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    save(spark.createDataFrame([(1, None)], "item_id long, text string"), tmp_path, "benchmark")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.schema.names == before.schema.names
        rows = docs.collect()
        assert rows and all([r[name] for name in names] == [str(n) for n in range(len(names))] for r in rows)


def test_all_stages(spark, tmp_path):
    rng = random.Random(1)
    line = "A line that very many of the documents have in common, word for word"
    item = " ".join("b%d" % rng.randrange(99) for _ in range(30))
    rows, labels = list(ODD), []
    for i in range(300):
        words = ["w%d" % rng.randrange(200) for _ in range(80)]
        if i % 6 == 0:
            words[5:5] = ["idiot", "moron", "idiot"]
        rows.append((100 + i, line + "\n" + " ".join(words)))
        labels.append((100 + i, 1, int(i % 6 == 0)))
    rows += [(1000, rows[-1][1] + " end"), (1001, "some words before " + item.upper() + " and after"), (1002, rows[-2][1].split("\n")[1])]
    save(documents(spark, rows), tmp_path)
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    save(spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"), tmp_path, "benchmark")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert {100 + i for i in range(300) if i % 6} <= ids
    gone = {100 + i for i in range(0, 300, 6)} | {1000, 1001, 1002}
    assert sorted(ids & gone, key=str) == []
    assert all(r.round_trip for r in got)


def test_odd_column_names_pass_through(spark, tmp_path):
    """A dot, a space, a backtick in names, also of a struct's fields, and names that stages use."""
    from pyspark.sql import functions as F

    line = "A line of licence text that very many of the documents have in common"
    rows = [(i, f"{line}\nword{i} other{i} words{i} of{i} its{i} own{i}") for i in range(12)]
    docs = documents(spark, rows)
    odd = docs.select("*", F.lit(1).alias("a.b"), F.struct(F.lit(2).alias("x y"), F.lit("q").alias("z.w")).alias("s t"), F.lit(3).alias("back`tick"), F.lit(4).alias("score"), F.lit(5).alias("n_lines"), F.lit(6).alias("__doc"))
    save(documents(spark, rows), tmp_path)
    save(spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    save(spark.createDataFrame([(1, "a long item of the benchmark that no document holds at all")], "item_id long, text string"), tmp_path, "benchmark")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, odd, str(tmp_path))
        assert out.schema.names == odd.schema.names, name
        got = out.collect()
        assert len(got) == 12 and all(r["a.b"] == 1 and r["s t"]["x y"] == 2 and r["back`tick"] == 3 and r["n_lines"] == 5 and r["__doc"] == 6 for r in got), name
    model = corpus_pipeline.toxicity.Model({"idiot$": (1.0, 1)}, [0.0] * 6, 0.5)
    got = corpus_pipeline.toxicity.score_documents(odd, model, "score_").collect()
    assert all(r["a.b"] == 1 and r["s t"]["z.w"] == "q" and r["score"] == 4 and r["score_"] == 0.5 for r in got)


def test_fingerprints_within_the_budget_are_candidates_without_bands(spark, monkeypatch):
    whole = simhash.copy_sketch

    def without_bands(shingles):
        digest, keys, minima = whole(shingles)
        return digest, keys * 0 + np.frombuffer(digest, dtype=np.int64)[0] + np.arange(len(keys)), minima

    rng = random.Random(9)
    words = ["w%d" % rng.randrange(3000) for _ in range(600)]
    far = ["v%d" % rng.randrange(3000) for _ in range(600)]
    texts = [" ".join(words), " ".join([*words, "end"]), " ".join(far)]
    prints = [simhash.majority_bits(simhash.shingle_set(t)) for t in texts]
    assert 0 <= (prints[0] ^ prints[1]).bit_count() <= simhash.COPY_BUDGET < (prints[0] ^ prints[2]).bit_count()
    monkeypatch.setattr(simhash, "copy_sketch", without_bands)
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_copies(documents(spark, list(enumerate(texts)))).collect())
    assert got == [(0, 0), (1, 0), (2, 2)]
