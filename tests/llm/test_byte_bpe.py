import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rallyframe.llm import byte_bpe

from .helpers import ODD, documents

PATH = P.path("byte_bpe_multi_50k.tiktoken")
BPE = byte_bpe.coder(PATH, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})


def check(text):
    ids = BPE.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text)
    assert BPE.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab \n\t'sé1!  ñ中​\x1c\x85　"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_equals_the_library(text):
    check(text)


@pytest.mark.parametrize("text", ["a" * 30000, "ab" * 10000, "é" * 9999, "".join(random.Random(1).choice("abcdehinot") for _ in range(40000)), "  a", "a  ", " \n a", "it's we'll", "<|endoftext|>"])
def test_long_and_odd(text):
    check(text)
    assert not any(BPE.low) and not any(BPE.mid)


def together(raws):
    ids, sizes = BPE.merge_many(raws)
    assert not any(BPE.low) and not any(BPE.mid)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text("ab", min_size=1, max_size=40), st.text("abcdehinotrs é中", min_size=1, max_size=20), st.text(min_size=1, max_size=8)), min_size=1, max_size=30))
def test_one_queue_for_many(tokens):
    raws = [t.encode("utf-8", "surrogatepass") for t in tokens]
    assert together(raws) == [BPE.merge(raw) for raw in raws]


def test_one_queue_for_very_many():
    rng = random.Random(4)
    tokens = ["".join(rng.choice(("th", "er", "in", "on", "an", "a", "é", "ß", "!!", "00")) for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    tokens += ["a" * n for n in range(1, 64)] + ["ab" * n for n in range(1, 32)] + ["", "x"]
    assert together([t.encode() for t in tokens]) == [BPE.merge(t.encode()) for t in tokens]
    own = byte_bpe.ByteBPE(BPE.ranks, P.PATTERN)
    own.learn([" ".join(tokens), "", "one  two\n"])
    assert own.encode(" ".join(tokens)) == BPE.encode(" ".join(tokens)) and len(own.tokens) > 1000


def test_documents(spark):
    rows = ODD
    df = documents(spark, rows).withColumnRenamed("lang", "ids").withColumnRenamed("source", "n_tokens")
    want = []
    for i, t in rows:
        ids = np.array(LIBRARY.encode_ordinary(t or ""), dtype="<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in byte_bpe.digest_documents(df, PATH, P.PATTERN).collect()), key=str) == sorted(want, key=str)
    got = byte_bpe.encode_documents(df, PATH, P.PATTERN).collect()
    assert all(r.round_trip and 4 * r.n_tokens == len(r.ids) for r in got) and len(got) == len(rows)
    assert byte_bpe.digest_documents(documents(spark, []), PATH, P.PATTERN).count() == 0


def test_caches_stay_bounded(monkeypatch):
    own = byte_bpe.ByteBPE(BPE.ranks, P.PATTERN)
    for name in ("CACHE_PIECES", "CACHE_TOKENS", "CACHE_PAIRS"):
        monkeypatch.setattr(byte_bpe, name, 50)
    text = " ".join("w%dx%d" % (i, i * i) for i in range(2000))
    assert own.encode(text) == BPE.encode(text) and len(own.pieces) <= 50 and len(own.tokens) <= 50
