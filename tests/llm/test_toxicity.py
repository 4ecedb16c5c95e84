import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from rallyframe.llm import toxicity as t

from .helpers import ODD, documents, save


def edits_to_beginning(term, token):
    """Least edits from the term to any beginning of the token (to the whole token for a closed term)."""
    letters = term.rstrip("$")
    row = list(range(len(token) + 1))
    for i, a in enumerate(letters, 1):
        new = [i]
        for j, b in enumerate(token, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1] if term.endswith("$") else min(row)


TERMS = {"idiot$": 1, "worthless$": 1, "scum$": 0, "lowei": 1, "disgusting$": 2, "vequ": 0}
TRIE = t.FuzzyTrie(TERMS)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text("idotscumlwevqrhng", max_size=12), st.sampled_from([x.rstrip("$") for x in TERMS]).flatmap(lambda w: st.tuples(st.integers(0, len(w)), st.text("aeiot", max_size=2), st.integers(0, 2)).map(lambda x: w[: x[0]] + x[1] + w[x[0] + x[2] :]))))
def test_trie_equals_edit_distance(token):
    found = [(e, term) for term, most in TERMS.items() if (e := edits_to_beginning(term, token)) <= most]
    assert TRIE.match(token) == (min(found) if found else None)


def test_quotation_counts_less():
    hits = lambda text: t.Scanner(TERMS).hits(text)
    abuse, quoted = "you are an idiot! and so on", 'and she wrote "idiot" in the report'
    assert [h[:3] for h in hits(abuse)] == [h[:3] for h in hits(quoted)] == [("idiot$", 0, 1)]
    assert hits(abuse)[0][3] < 0.2 < 0.5 < hits(quoted)[0][3]
    both = hits(abuse + "\n" + quoted)[0]
    assert both[:3] == ("idiot$", 0, 2) and abs(both[3] - hits(abuse)[0][3] - hits(quoted)[0][3]) < 1e-9


def test_a_term_deep_in_a_quotation_is_quoted():
    far = "one two three four five six seven eight nine ten eleven twelve "
    score = lambda text: t.Scanner(TERMS).hits(text)[0][3]
    for a, b in ('""', "“”", "„“", "«»", "»«", "‘’"):
        assert score(f"{far}{a}{far}idiot {far}{b}{far}") >= 0.6
        assert score(f"{far}{a}{far}{b}{far}idiot {far}{a}{far}{b}") == 0
        assert score(f"{far}{a}{far}\n{far}idiot {far}\n{far}{b}") == 0


def test_the_automaton_starts_anew(monkeypatch):
    tokens = ["idiot", "idoit", "wortless", "disgustin", "vequx", "nothing", "idiots"]
    want = [t.FuzzyTrie(TERMS).match(x) for x in tokens]
    monkeypatch.setattr(t, "STATES", 3)
    trie = t.FuzzyTrie(TERMS)
    assert [trie.match(x) for x in tokens * 2] == want * 2 and len(trie.members) < 60


def brute_score(model, text):
    """The score from every token and term by plain edit distances."""
    text = text or ""
    sums = {}
    low = text.lower()
    words = list(t.WORD.finditer(low))
    for at, m in enumerate(words):
        found = [(e, term) for term, (_, most) in model.terms.items() if (e := edits_to_beginning(term, m.group())) <= most]
        if found:
            e, term = min(found)
            inside = any(q.start() <= m.start() and m.end() <= q.end() for q in t.QUOTED.finditer(low))
            n, quote = sums.get((term, e), (0, 0.0))
            sums[term, e] = n + 1, quote + t.quotation(text, words, at, inside)
    x = t.features([(*k, *v) for k, v in sums.items()], len(text.split()), model.terms)
    return 1 / (1 + t.math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))


def test_scores_equal_brute_force(spark):
    rows, labels = corpus()
    rows = [*rows[:120], (5000, 'he said "you idiot" and «scum»'), (5001, "worthles patetic idiott " * 40), (5002, "Idiot! you SCUM " + "w " * 20_000)]
    docs = documents(spark, corpus()[0])
    model = t.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.terms
    got = sorted((str(r.doc_id), round(r.toxicity, 9)) for r in t.score_documents(documents(spark, rows), model).collect())
    assert got == sorted((str(i), round(brute_score(model, text), 9)) for i, text in rows)


def test_a_repeated_document_is_learned_from_once(spark):
    rows, labels = corpus()
    kind = "doc_id long, quality int, toxic int"
    plain = t.fit(documents(spark, rows), spark.createDataFrame(labels, kind))
    again = t.fit(documents(spark, [*rows, *rows[50:300]]), spark.createDataFrame(labels, kind))
    assert plain.terms == again.terms and plain.weights == again.weights


def corpus():
    rng = random.Random(3)
    bad = ["idiot", "scum", "worthless", "pathetic"]
    rows, labels = list(ODD), []
    for i in range(900):
        words = ["w%s" % rng.choice("abcdefghijklmnop") * 2 for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(50), rng.choice(bad))
        rows.append((100 + i, " ".join(words)))
        labels.append((100 + i, 1, int(toxic)))
    return rows, labels + [(100, 1, None), (5, None, 0), (5, None, 0), (999999, 1, 1), (None, 1, 1)]


def test_held_out_accuracy(spark, tmp_path):
    rows, labels = corpus()
    save(documents(spark, rows).withColumnRenamed("lang", "score"), tmp_path)
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    got = t.op1_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    toxic = {i: y for i, _, y in labels[:900]}
    held = [r for r in got if r.doc_id in toxic and r.held_out]
    assert len(held) > 200 and all(r.predicted == toxic[r.doc_id] for r in held)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_held_out_labels_are_never_read(spark, tmp_path):
    rows, labels = corpus()
    docs = documents(spark, rows)
    kind = "doc_id long, quality int, toxic int"
    flipped = [(i, q, y if i is None or y is None or zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, q, y in labels]
    a, b = (t.fit(docs, spark.createDataFrame(x, kind)) for x in (labels, flipped))
    assert a.terms == b.terms and a.weights == b.weights


def test_one_kind_of_labels_or_none(spark):
    docs = documents(spark, ODD)
    for labels, base in (([], 0.0), ([(5, 1, 1), (6, 1, 1), (7, 1, 1)], 1.0)):
        model = t.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert not model.terms and model.base == base
        assert {r.toxicity for r in t.score_documents(docs, model).collect()} == {base}


def test_empty_table(spark):
    model = t.Model({"idiot$": (1.0, 1)}, [0.0] * 6, 0.1)
    assert t.score_documents(documents(spark, []), model).count() == 0


def test_long_terms_that_agree_in_many_letters_are_told_apart(spark):
    stem = "unverbesserlichkeitsvorwurf"
    rows = [(i, f"some words {i} {stem}{'hasser' if i % 2 else 'freunde'} and {'x' * 5000 if i == 3 else 'more'}") for i in range(80)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    model = t.fit(documents(spark, rows), labels)
    assert any(term.startswith(stem + "hasser"[:1]) for term in model.terms)
    scored = {r.doc_id: r.toxicity for r in t.score_documents(documents(spark, [(1, f"a {stem}hasser b"), (2, f"a {stem}freunde b")]), model).collect()}
    assert scored[1] > 0.5 > scored[2]


def test_short_terms_have_an_edit():
    trie = t.FuzzyTrie({"scum$": t.edits_for("scum$")})
    assert [trie.match(x) for x in ("scum", "scuum", "scm", "skum", "sc", "scums")] == [(0, "scum$"), (1, "scum$"), (1, "scum$"), (1, "scum$"), None, (1, "scum$")]


def test_context_is_counted_in_words_of_any_length():
    long_ = "w" * 300
    hits = lambda text: t.Scanner({"idiot$": 1}).hits(text)[0][3]
    assert hits(f"said {long_} {long_} {long_} {long_} {long_} idiot") == 0.4
    assert hits(f"said {long_} {long_} {long_} {long_} {long_} {long_} idiot") == 0
