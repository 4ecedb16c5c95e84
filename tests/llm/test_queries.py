"""Every registered query on small tables with odd rows: its contract's columns, and values by plain Python."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from rallyframe.llm import queries as q

from . import test_max_score, test_paragraph_sketch, test_secrets, test_simhash, test_spelling, test_vector_codes
from .helpers import ODD, documents, save

LINE = "A line that some of the documents have in common, word for word"
ITEM = "Which of these is the longest river that flows through three countries and two deserts"
ROWS = [*ODD, *[(20 + i, f"{LINE}\nbody {i} password = abcdef{i:08d}") for i in range(7)], (40, f"before {ITEM.upper()}, after"), (41, "you idiot " * 30)]
PAGE = "<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>Some words of an article that goes on for a while.</p></article></body>"

RNG = np.random.default_rng(3)
VECTORS = [(i, int(i % 4), [float(x) for x in RNG.normal(0, 0.2, 16).astype(np.float32)]) for i in range(300)]
VECTORS += [(None, None, VECTORS[5][2]), (500, 1, None), (501, 1, [float("nan")] * 16), (50, 2, VECTORS[50][2]), (600, 0, VECTORS[7][2]), (601, 0, [float("inf")] + [0.0] * 15)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    save(documents(spark, ROWS), path)
    save(spark.createDataFrame([(20 + i, 1, i % 2) for i in range(7)], "doc_id long, quality int, toxic int"), path, "labels")
    save(spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "two words")], "item_id long, text string"), path, "benchmark")
    save(spark.createDataFrame([(i, v, label) for i, label, v in VECTORS], "vec_id long, embedding array<float>, label int"), path, "embeddings")
    save(spark.createDataFrame([(1, "u", PAGE), (None, None, None), (1, "u", PAGE)], "page_id long, url string, html string"), path, "pages")
    return str(path)


def run(spark, folder, name):
    return q.queries()[name](spark, folder).collect()


def by_id(rows):
    return sorted(rows, key=str)


def test_op1(spark, folder):
    got = run(spark, folder, "op1_toxicity")
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_op2(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4").tobytes()) for i, t in ROWS]
    got = run(spark, folder, "op2_token_store")
    assert by_id((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == by_id((i, len(x) // 4, zlib.crc32(x)) for i, x in ids)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.verified
        start += r.n_tokens
    known = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)


def test_op3(spark, folder):
    got = run(spark, folder, "op3_secrets")
    assert by_id((r.doc_id, r.base_sha256) for r in got) == by_id((i, hashlib.sha256(test_secrets.brute_base(t).encode()).hexdigest()) for i, t in ROWS)
    assert sum(r.n_assign for r in got) == 7


def test_op4(spark, folder):
    got = run(spark, folder, "op4_paragraph_sketch")
    have = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert by_id(have) == by_id(test_paragraph_sketch.brute(ROWS))
    of = {}
    for r in got:
        assert of.setdefault(r.edited_sha256, r.edited_fingerprint) == r.edited_fingerprint


def test_op5(spark, folder):
    text = "Title Some words of an article that goes on for a while."
    got = run(spark, folder, "op5_html_text")
    assert by_id((r.page_id, r.url, r.text, r.n_chars) for r in got) == by_id([(1, "u", text, len(text))] * 2 + [(None, None, "", 0)])


def test_op6(spark, folder):
    got = run(spark, folder, "op6_decontaminate")
    assert by_id((r.doc_id, r.item_id) for r in got) == by_id([(40, 1), (5, 4)])


def test_op7(spark, folder):
    got = run(spark, folder, "op7_line_dedup")
    keep = {i: t for i, t in ROWS} | {20 + i: f"body {i} password = abcdef{i:08d}" for i in range(6)}
    want = [(i, (t or "").count("\n") + 1, int(i in range(20, 26)), hashlib.sha256((keep[i] or "").encode()).hexdigest()) for i, t in ROWS]
    assert by_id((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == by_id(want)


def test_op8(spark, folder):
    got = run(spark, folder, "op8_sharding")
    assert by_id((r.doc_id, r.size, r.text_crc32) for r in got) == by_id((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    places = {}
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < 40 and r.grown_shard is None
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_op9(spark, folder):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in ROWS:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = run(spark, folder, "op9_byte_bpe")
    assert by_id((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == by_id(want)


def test_op10(spark, folder):
    prints = sorted(((i, test_simhash.brute_print(t)) for i, t in ROWS), key=lambda p: (p[0] is None, p))
    label = test_simhash.brute_components(prints, 2)
    got = run(spark, folder, "op10_simhash")
    assert by_id((r.doc_id, r.fingerprint, r.component_id) for r in got) == by_id((i, f"{k:016x}", prints[label[n]][0]) for n, (i, k) in enumerate(prints))


def test_op11(spark, folder):
    got = run(spark, folder, "op11_vector_codes")
    assert by_id((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == by_id(test_vector_codes.brute(VECTORS))


def test_op12(spark, folder):
    want = test_spelling.brute(test_spelling.brute_words(ROWS))
    assert sorted(tuple(r) for r in run(spark, folder, "op12_spelling")) == want and want


def test_op13(spark, folder):
    got = run(spark, folder, "op13_max_score")
    assert by_id((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == by_id(test_max_score.brute([(i, v) for i, _, v in VECTORS]))
