import hashlib
import math
import random
import re
import time

import pytest

from rallyframe.llm import secrets as s

from .helpers import ODD, documents


def brute_base(text):
    out = []
    kinds = (
        ("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    )
    for n, (kind, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def corpus():
    rng = random.Random(8)
    words = ["%s%s" % (a, b) for a in ("the", "erth", "nder", "tion", "ing") for b in ("ation", "er", "ou", "", "eadcafe")]
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    rows = list(ODD)
    planted = {}
    for i in range(400):
        own = [rng.choice(words) for _ in range(80)]
        if i % 4 == 0:
            own.insert(9, rng.choice(['token = "%s"', "Api_Key:%s", "PASSWORD='%s", "ſecret=%s"]) % draw("abcdef0123456789", rng.choice([8, 12, 40])))
        if i % 5 == 0:
            own.insert(20, "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", rng.choice([9, 16])))
        if i % 6 == 0:
            own.insert(30, draw("0123456789abcdef", rng.choice([15, 16, 64])))
        if i % 7 == 0:
            planted[1000 + i] = draw(s.SYMBOLS[:62], 44)
            own.insert(40, planted[1000 + i])
        if i % 3 == 0:
            own.insert(50, "ühr" + "erberbeeinheitkeiter" * 2)
        rows.append((1000 + i, " ".join(own)))
    return rows, planted


def test_base_and_added_spans(spark):
    rows, planted = corpus()
    df = documents(spark, rows).withColumnRenamed("lang", "base").withColumnRenamed("source", "found")
    got = s.find_secrets(df).collect()
    want = sorted((i, hashlib.sha256(brute_base(t).encode()).hexdigest()) for i, t in rows if i is not None)
    assert sorted((r.doc_id, r.base_sha256) for r in got if r.doc_id is not None) == want
    texts = dict(rows)
    caught = 0
    for r in got:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        base = [x for x in spans if x[0] != "random"]
        assert ",".join(":".join(x) for x in base) == brute_base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in base) for k in s.KINDS[:3]]
        for _, a, b in (x for x in spans if x[0] == "random"):
            assert r.doc_id in planted and planted[r.doc_id] in texts[r.doc_id][int(a) : int(b)]
            caught += 1
    assert caught >= 0.9 * len(planted)


def test_battery_tells_words_from_draws():
    rng = random.Random(1)
    alphabet = dict(s.ENCODINGS)["base62"]
    joint = [s.battery_p("".join(rng.choice(alphabet) for _ in range(40)), alphabet) for _ in range(500)]
    assert sum(p >= s.ALPHA for p in joint) >= 480
    assert 0.35 < sum(joint) / len(joint) < 0.75  # so that weights of twice the p-value are about 1 on average
    assert s.battery_p("erberbeeinheitkeiter" * 3, s.infer("erberbeeinheitkeiter")[1]) < s.ALPHA
    assert s.battery_p("abcdefghijklmnopqrstuvwxyz" * 2, dict(s.ENCODINGS)["base36"]) < s.ALPHA
    assert s.simes([0.5, 0.01, 0.9]) == pytest.approx(0.03) and s.simes([1.0, 1.0, 1.0]) == 1


def test_thresholds_equal_the_procedure_on_sorted_p_values(spark):
    rng = random.Random(2)
    found = []
    for c in range(3):
        for _ in range(300):
            u = rng.random()
            found.append((c, None if u < 0.3 else -rng.expovariate(1) if u < 0.8 else -rng.uniform(3, 60)))
    rows = [([{"a": 0, "b": 1, "class": c, "log_p": x} for c, x in found[i : i + 50]],) for i in range(0, len(found), 50)]
    df = spark.createDataFrame(rows, "found array<struct<a:bigint,b:bigint,class:int,log_p:double>>")
    got = s.thresholds(df)
    for c in range(3):
        steps = [math.floor(-x / math.log(10) / s.STEP) if x is not None else 0 for k, x in found if k == c]
        ranked = sorted((10 ** (-k * s.STEP) for k in steps))
        most = max(i for i, p in enumerate(ranked, 1) if p <= s.Q * i / len(ranked))
        assert 0 < most < 300 and sum(k >= got[c] for k in steps) == most


def test_a_text_of_very_many_spans_takes_linear_time():
    model = s.Bigrams({})
    took = []
    for n in (1000, 8000):
        text = "token=abcdefgh12345678 /static/wordswordswords/wordswordswordswords " * n
        began = time.process_time()
        base = s.base_spans(text)
        s.strongest([f for f in s.candidates(text, base, model) if f["log_p"] is not None])
        took.append(time.process_time() - began)
    assert len(base) == 8000 and took[1] < 24 * max(took[0], 0.05)


def test_encodings():
    assert [s.infer(t)[0] for t in ("12", "0af", "0AF", "XB23", "xyz1", "XYZ1", "aZ9", "a+Z9==", "a_Z-9")] == [e[0] for e in s.ENCODINGS]
    assert s.infer("a+b_c") is None and s.infer("===") is None


def test_values_glued_to_names_and_paths(spark):
    rng = random.Random(3)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    base62, urls = s.SYMBOLS[:62], s.SYMBOLS[:62] + "-_"
    forms = (("AWS_SESSION=%s", base62), ("x?sig=%s==&y", s.SYMBOLS[:64]), ("--auth=%s", base62), ("/static_files/user-pages/%s", urls), ("/the/nation/over/there/under/%s/edit", base62), ("user_name-%s", s.SYMBOLS[:64]))
    rows, planted = corpus()[0], {}
    for i in range(120):
        form, alphabet = forms[i % len(forms)]
        planted[5000 + i] = draw(base62, 1) + draw(alphabet, 42) + draw(base62, 1)
        rows.append((5000 + i, "some words before " + form % planted[5000 + i] + " and after"))
    texts, caught = dict(rows), dict.fromkeys(range(len(forms)), 0)
    for r in s.find_secrets(documents(spark, rows)).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x.startswith("random")]
        ends = [0, *[int(x) for _, a, b in spans for x in (a, b)]]
        assert ends == sorted(ends)
        if r.doc_id in planted:
            caught[(r.doc_id - 5000) % len(forms)] += any(planted[r.doc_id] in texts[r.doc_id][int(a) : int(b)] for _, a, b in spans)
    assert min(caught.values()) >= 15


def test_empty_table(spark):
    assert s.find_secrets(documents(spark, [])).count() == 0
