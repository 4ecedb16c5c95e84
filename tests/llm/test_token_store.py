import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rallyframe.llm import token_store
from rallyframe.llm.ordering import range_bounds, range_of

from .helpers import ODD, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def encoded(encoder, texts, end_id=None):
    ids, counts = encoder.encode(pa.array(texts, pa.string()), end_id)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(texts) else []


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [*ODD, (9, "<|endoftext|> is text"), (10, " x\n y  z ")]
    path = "file://" + str(tmp_path_factory.mktemp("store") / "s")
    token_store.write_store(documents(spark, rows).withColumnRenamed("lang", "chunks"), path, PATH)
    return rows, path


def test_rows_follow_the_files(spark, store):
    rows, path = store
    got = token_store.verify_store(spark, path).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    want = sorted(((i, ids_of(t)) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    by_start = sorted(got, key=lambda r: r.start)
    for (doc_id, ids), row in zip(want, by_start, strict=True):
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), crc)
        start += len(ids)


def test_special_tokens_as_the_library_has_them():
    texts = ["<|endoftext|> is text", "text  <|endoftext|>\n <|endoftext|>", "a<|endoftext|>b <|endoftext| >", "plain text  ", " <|endoftext|>"]
    got = encoded(token_store.PieceEncoder(PATH), texts)
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [50256, 318, 2420]


@pytest.mark.parametrize("pieces", [600_000, 300])
def test_equals_the_library(monkeypatch, pieces):
    monkeypatch.setattr(token_store, "CACHE_PIECES", pieces)
    rng = np.random.default_rng(5)
    parts = ["word", "Été", "naïve", "don't", "I'll", "x1y22", "10,000", "…", "--", "\n", "\n\n", "\t", " ", "  ", "中文字", "ﬁ", "🙂", "a" * 70, "é" * 90 + ".", "\u00a0", "\u2003", "\x1c", "½", "²", "ª", "'s", "</p>", "\r\n", "Ǆ", "\u0300", "𓀀", "\ua7cb", "\u2028"]
    texts = ["".join(rng.choice(parts) + (" " if rng.random() < 0.6 else "") for _ in range(int(rng.integers(0, 60)))) for _ in range(1200)]
    texts += [chr(c) + " x" + chr(c) + "y" + chr(c) + chr(c) + "\n" + chr(c) + "1 " + chr(c) + "." for c in range(0x260)]
    texts += ["", " ", "  a", "a ", "a  b", "\n", None, "a" * 70, "x " + "b" * 500 + " y", "word. Word.\nWord"]
    encoder = token_store.PieceEncoder(PATH)
    got = [ids for at in range(0, len(texts), 100) for ids in encoded(encoder, texts[at : at + 100], 7)]
    assert got == [LIBRARY.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]


def test_what_a_batch_knows_is_not_learned_again(monkeypatch):
    """Several batches later a word is still known, and a full cache starts anew with the same ids."""
    monkeypatch.setattr(token_store, "CACHE_PIECES", 500)
    encoder = token_store.PieceEncoder(PATH)
    learned = []
    own = encoder._learn_runs
    monkeypatch.setattr(encoder, "_learn_runs", lambda new, spaced: learned.extend(new.to_pylist()) or own(new, spaced))
    batches = [[f"common thing{n}, {'common ' * n}w{n}." for n in range(k, k + 20)] for k in range(0, 200, 20)]
    for texts in batches:
        assert encoded(encoder, texts, 0) == [ids_of(t) for t in texts]
    assert learned.count("common") <= 2  # with and without a space in front
    for texts in ([f"x{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}{chr(97 + n // 676)} common" for n in range(1200)], *batches):
        assert encoded(encoder, texts, 0) == [ids_of(t) for t in texts]
    assert 2 < learned.count("common") <= 4
    assert all(len(known.words) <= 2 * 1200 for both in (encoder.pieces, encoder.runs) for known in both.values())


def test_chunks_of_two_and_of_four_bytes_an_id(spark):
    few, many = np.arange(5, dtype="<u2"), np.arange(70000, 70009, dtype="<u4")
    good = [(token_store.digest(x.tobytes()), len(x), x.tobytes()) for x in (few, many)]
    rows = [*good, (good[0][0], 5, b"0123456789"), (good[1][0], 8, good[1][2]), (token_store.digest(b"abc"), 2, b"abc")]
    got = {(r.digest, r.sound, r.n, r.crc) for r in token_store._chunk_facts(spark.createDataFrame(rows, "digest binary, n_ids int, ids binary").coalesce(1)).collect()}
    wanted = {(digest, True, len(x), zlib.crc32(x.astype("<u4").tobytes())) for (digest, _, _), x in zip(good, (few, many), strict=True)}
    assert wanted <= got and sum(r[1] for r in got) == 2 and len(got) == len(rows)


def test_round_trip(spark, store):
    rows, path = store
    got = sorted((str(r.doc_id), r.ids) for r in token_store.read_documents(spark, path).collect())
    assert got == sorted((str(i), ids_of(t)) for i, t in rows)


def test_chunks_are_stored_once(spark, store):
    _, path = store
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert spark.read.parquet(f"{path}/manifest").agg({"n_documents": "sum"}).first()[0] == len(store[0])


def test_a_damaged_chunk_is_noticed(spark, store, tmp_path):
    _, path = store
    bad = f"file://{tmp_path}/bad"
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{bad}/recipes")
    chunks = spark.read.parquet(f"{path}/chunks")
    chunks.selectExpr("digest", "n_ids", "if(n_ids > 2, encode(repeat('x', 2 * n_ids), 'utf-8'), ids) ids").write.parquet(f"{bad}/chunks")
    got = token_store.verify_store(spark, bad).collect()
    assert any(not r.verified for r in got) and any(r.verified for r in got)


@pytest.mark.parametrize("change", ["start > 0", "start > 0 or range = {top}", "doubled", "moved", "no range"])
def test_recipes_unlike_the_manifest_are_noticed(spark, store, tmp_path, change):
    _, path = store
    bad = f"file://{tmp_path}/bad"
    recipes = spark.read.schema(token_store.RECIPES).parquet(f"{path}/recipes")
    ends = recipes.selectExpr("min(start)", "max(start)", "max(range)").first()
    if change == "doubled":
        changed = recipes.union(recipes.where(f"start = {ends[1]}"))
    elif change == "moved":
        changed = recipes.withColumn("start", recipes.start + 1)
    elif change == "no range":
        changed = recipes.where(f"range <> {ends[2]}")
    else:
        changed = recipes.where(change.format(top=ends[2]))
    changed.write.partitionBy("range").parquet(f"{bad}/recipes")
    for name in ("chunks", "manifest"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{bad}/{name}")
    first = recipes.where("start = 0").first()["range"]
    got = token_store.verify_store(spark, bad).collect()
    ranges = {r.start: r["range"] for r in changed.collect()}
    assert got
    if change in ("no range", "moved"):
        assert not any(r.verified for r in got)
    elif change == "doubled":
        assert not any(r.verified for r in got if ranges[r.start] == ends[2])
    else:
        assert not any(r.verified for r in got if ranges[r.start] == first)


def test_a_key_of_very_many_rows_is_cut_by_the_tie(spark):
    rows = [(None, i * 7919 % 3001) for i in range(3000)] + [(5, i * 104729 % 3001) for i in range(3000)] + [(i, 0) for i in range(6, 3000)]
    df = spark.createDataFrame(rows, "k long, tie long")
    bounds = range_bounds(df, "k", "tie", 30)
    got = df.select("k", "tie", range_of("k", "tie", bounds).alias("r")).collect()
    ordered = sorted(got, key=lambda r: (r.k is not None, r.k or 0, r.tie))
    assert [r.r for r in ordered] == sorted(r.r for r in got)
    sizes = Counter(r.r for r in got)
    assert max(sizes.values()) < 1000 and len(sizes) > 20
    assert range_bounds(df.limit(0), "k", "tie", 30) == []


def test_shifted_passages_share_chunks():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50000, 20000).astype(np.uint16)
    parts = lambda x: {x[a:b].tobytes() for a, b in zip([0, *token_store.cut_points(x)], token_store.cut_points(x), strict=False)}
    a, b = parts(ids), parts(np.concatenate([ids[:7], ids]))
    assert len(a & b) > 0.9 * len(a)
    assert max(map(len, a)) <= 2 * token_store.MOST_IDS


def test_streams_are_cut_alike_alone_and_together(monkeypatch):
    monkeypatch.setattr(token_store, "MOST_IDS", 300)
    rng = np.random.default_rng(2)
    streams = [rng.integers(0, 50000, int(n)).astype(np.uint16) for n in [0, 1, 3, 4, 5, 0, 900, 2, 301, 300, 5000, 0]]
    streams.append(np.full(1000, 3, dtype=np.uint16))
    ends, n = token_store.cut_streams(np.concatenate(streams), np.array([len(x) for x in streams]))
    at = np.concatenate([[0], np.cumsum([len(x) for x in streams])])
    for i, own in enumerate(np.split(ends, np.cumsum(n)[:-1])):
        mine = (own - at[i]).tolist()
        assert mine == token_store.cut_points(streams[i])
        assert all(0 < b - a <= 300 for a, b in zip([0, *mine], mine, strict=False)) and (mine[-1:] or [0]) == [len(streams[i])]


def test_joined_checksums():
    messages = [[], [b""], [b"", b"a", b"bcd" * 99, bytes(5000)], [b"x" * 70000, b"y"], [bytes([i]) for i in range(200)]]
    flat = [p for m in messages for p in m]
    got = token_store.crc32_joined(np.array([zlib.crc32(p) for p in flat], dtype=np.uint32), np.array([len(p) for p in flat]), np.array([len(m) for m in messages]))
    assert got.tolist() == [zlib.crc32(b"".join(m)) for m in messages]


def test_empty_table(spark, tmp_path):
    token_store.write_store(documents(spark, []), f"file://{tmp_path}/e", PATH)
    assert token_store.verify_store(spark, f"file://{tmp_path}/e").count() == 0
