import random

from rallyframe.llm import decontaminate as d

from .helpers import ODD, documents


def levenshtein_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdehinorst") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 30)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "too short"), (23, items[0][1]), (None, items[1][1])]
    docs = list(ODD)
    for i in range(60):
        own = [word() for _ in range(60)]
        if i % 3:
            text = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 14)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 1)] = rng.choice(["", "x", ".", "q "])
            own.insert(rng.randrange(60), "".join(text).upper() if i % 2 else "".join(text))
        docs.append((100 + i, " ".join(own)))
    return items, docs


def brute(items, docs):
    out = []
    for i, t in docs:
        for n, item in items:
            a, b = d.squeezed(item), d.squeezed(t)
            if len(a) >= d.ERROR_EVERY and b and len(b) < 5000:
                edits = levenshtein_inside(a, b)
                if edits <= len(a) // d.ERROR_EVERY:
                    out.append((i, n, edits))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    items, docs = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents(spark, docs).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "edits")
    want = brute(items, docs)
    for block_bytes in (d.BLOCK_BYTES, 300):
        got = sorted(((r.doc_id, r.item_id, r.edits) for r in d.find_leaks(df, bench, block_bytes).collect()), key=str)
        assert got == want
    kept = {r.doc_id for r in d.drop_leaks(df, bench, 300).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _, _ in want}
    assert len(want) > 20 and any(e for _, _, e in want)


def test_every_length_by_one_rule(spark):
    """An edit for each 16 letters: exact below, one wrong letter or none from 16 on, two from 32 on; glued to other letters too."""
    rng = random.Random(7)
    for n in (8, 15, 16, 24, 31, 32, 40):
        item = "".join(rng.choice("abcdehinorst") for _ in range(n - 1)) + "q"
        texts = ["x" + item + "y", f"so {item}.", *[f"so {item[:at]}w{item[at + k :]} it" for at in (0, n // 2, n - 1) for k in (0, 1)], f"so {item[: n // 3]}{item[n // 3 + 2 :]} it", f"w{item[1 : n // 2]}w{item[n // 2 + 1 :]}"]
        bench = spark.createDataFrame([(1, item)], "item_id long, text string")
        got = {(r.doc_id, r.edits) for r in d.find_leaks(documents(spark, list(enumerate(texts))), bench).collect()}
        near = {(i, levenshtein_inside(item.encode(), d.squeezed(t))) for i, t in enumerate(texts)}
        assert got == ({(i, e) for i, e in near if e <= n // 16} if n >= 16 else {(1, 0)}), n


def test_very_long_and_periodic_texts():
    import time

    items = [(1, b"ab" * 8000), (2, b"abcd" * 3000 + b"x"), (3, b"q" * 40)]
    began = time.perf_counter()
    got = d.Finder(items).find("ab " * 32_000 + "abcd" * 100 + "q" * 39 + " " + "word " * 100_000)
    assert [h[:2] for h in got] == [(1, 0), (3, 1)] and time.perf_counter() - began < 20


def test_short_items_as_exact_copies(spark):
    bench = spark.createDataFrame([(1, "New France?!"), (2, "é ab"), (3, "?!"), (4, None)], "item_id long, text string")
    texts = ["Q: NEW France?", "new Francesca", "renew France", "New's France", "new\n- France", "x é-ab.", "éé ab", "new francesca, new france", ""]
    df = documents(spark, list(enumerate(texts)))
    got = sorted((r.doc_id, r.item_id, r.edits, r.hit_end) for r in d.find_leaks(df, bench).collect())
    assert got == [(0, 1, 0, 10), (4, 1, 0, 9), (5, 2, 0, 5), (7, 1, 0, 21)]
    assert {r.doc_id for r in d.drop_leaks(df, bench).collect()} == {1, 2, 3, 6, 8}


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    df = documents(spark, ODD)
    assert d.find_leaks(df, bench).count() == 0
    assert d.drop_leaks(df, bench).count() == len(ODD)
    assert d.find_leaks(documents(spark, []), spark.createDataFrame([(1, "x" * 99)], bench.schema)).count() == 0
