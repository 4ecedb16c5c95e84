"""op12 against plain Python, and its cases."""

import random
import re
import zlib
from collections import Counter

from rallyframe.llm import spelling

from .helpers import ODD, documents

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, n, **settings):
    df = spark.createDataFrame(sorted(n.items()), "word string, n long")
    return sorted(tuple(r) for r in spelling.group_variants(df, **settings).select("word", "form", "root", "n", "n_near", "form_n").collect())


def some_words(seed, letters="ab", size=300, lengths=(7, 9)):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))): rng.choice([2, 3, 30, 300, 4000]) for _ in range(size)}


def test_all_near_words_of_a_small_alphabet(spark):
    n = some_words(1)
    assert run(spark, n) == brute(n)


def test_buckets_cut_down_to_a_letter(spark):
    n = some_words(2, letters="abÿ") | {f"prefixed{c}tail": 5 for c in "abcdefgh"} | {"a" * 40: 2, "a" * 41: 20, "a" * 42: 200, "b" + "a" * 40: 9}
    assert run(spark, n, bucket=1) == run(spark, n, bucket=10_000) == brute(n)


def test_repeated_letters_and_shifts(spark):
    n = {"aaaaaaa": 2, "aaaaaaaa": 2, "aaaaaaaaa": 2, "abababab": 3, "babababa": 3, "bababab": 30, "ababababa": 300}
    assert run(spark, n) == brute(n)


def test_forms_end_in_a_root(spark):
    chain = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000, "abcdefghijkl": 200000, "zabcdefg": 20, "yabcdefg": 20}
    got = run(spark, chain)
    assert got == brute(chain) and dict((r[0], r[2]) for r in got)["abcdefg"] == "abcdefghijkl"


def test_words_of_documents(spark):
    rng = random.Random(3)
    base = ["Einigkeit", "éclairée", "notebook", "BEAUTIFUL", "Straßenbahn", "MÜLLERINNEN", "week÷end×long"]
    rows = [*ODD, *[(i, " ".join(rng.choice(base) for _ in range(60)) + ", x1y2") for i in range(40)], (None, "notebook " * 90), (7, "y" * 3000 + " " + "y" * 3000 + " " + "y" * 2999)]
    got = {r.word: r.n for r in spelling.word_counts(documents(spark, rows)).collect()}
    assert got == brute_words(rows)
    assert run(spark, got) == brute(got)


def test_no_words(spark):
    assert spelling.group_variants(spelling.word_counts(documents(spark, [(1, None), (2, "short words only")]))).collect() == []
    assert spelling.group_variants(spelling.word_counts(documents(spark, []))).collect() == []
