r"""Spelling variants by an even-partition pigeonhole join (DataFrame operations only).

Words are runs of letters, some with a planted slip. A word of length L is cut into two segments, of floor(L/2) and the
other letters. If two words are one edit apart, one of the segments of the shorter is whole in the other: the first at
its beginning, the second at its end, that is shifted by the difference in length. So each word is indexed by both
segments under its length, and probes the index with its own substrings at these places, for equal words and for those
one letter shorter. What meets under a key is a candidate and is verified by its edit distance inside the join, so no
pair leaves it unverified; then pairs found by both segments are made one.

Under a segment that more than BUCKET words share, these are not compared: the open part (where the edit must be) is cut
in two again, which is the same rule on a shorter word, until the words of a bucket are few or the open part is a
letter, when they are at most as many as there are letters. So no bucket is compared as a whole, however common its
segment, and no link is lost.

A word's form is the near word of the largest count if that is `times` its own, and the root is where the forms end.
Counts grow by that factor from step to step, so the chains are short; they are halved in rounds.

Cases: a null text holds no word; a null doc_id is the empty string in the checksum; repeated rows count again; ties of
counts go to the smaller word by code points; words of any length are treated alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import stored, table

LETTERS = "A-Za-zÀ-ÿ"
#: Words under one key that are compared with each other; more are cut further.
BUCKET = 32


def word_counts(docs: DataFrame, shortest: int = 7, least: int = 2, slip: int = 31) -> DataFrame:
    """word, n. A run whose crc32(doc_id:run) `slip` divides loses the code point at that number modulo its length."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}+"), F.lit(0))).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("run"))
    hashed = runs.select(lower.alias("run"), "id").select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _opened(words: DataFrame) -> DataFrame:
    """Each word as one of the index (extra 0) and as a probe for words that are a letter shorter (extra 1).

    The open part is that of an indexed word from lo to hi; a probe's is longer by `extra`.
    """
    sides = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("extra"))
    return sides.select("*", F.lit(0).alias("lo"), (F.length("word") - F.col("extra")).alias("hi"))


def _segments(entries: DataFrame) -> DataFrame:
    """The open part cut into two, each once closed and once open; the key holds all that is closed."""
    middle = F.expr("lo + (hi - lo) div 2")
    halves = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi")))
    cut = entries.select("word", "n", "extra", F.explode(halves).alias("o")).select("word", "n", "extra", "o.lo", "o.hi")
    length = F.length("word") - F.col("extra")
    before, after = F.substring(F.col("word"), F.lit(1), F.col("lo")), F.substring(F.col("word"), F.col("hi") + F.col("extra") + 1, F.length("word"))
    return cut.withColumn("key", F.xxhash64(length, "lo", "hi", before, after))  # equal keys of others are told apart by the distance


def _verified(entries: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: words of one bucket that are one edit apart, each pair once or more often."""
    index = entries.where("extra = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    probe = entries.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "extra")
    near = F.levenshtein(F.col("a"), F.col("b"), 1) == 1
    met = index.join(probe, (index["key"] == probe["key"]) & ((F.col("extra") == 1) | (F.col("a") < F.col("b"))) & near)
    return met.select("a", "a_n", "b", "b_n")


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """word, other, other_n: all words one inserted, deleted or replaced code point away, both ways. words: word, n."""
    found, entries = None, _segments(_opened(words))
    while True:
        sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        large = stored(sizes.where((F.col("size") > bucket) & (F.col("open") > 1)).select("key"), "large")
        pairs = stored(_verified(entries.join(large, "key", "left_anti")), "pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if large.isEmpty():
            break
        entries = stored(_segments(entries.join(large, "key", "left_semi")), "segments")
    once = found.distinct()
    back = once.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    return once.unionByName(back).select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms, from word and form where there is one."""
    links = stored(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("from"), F.col("root").alias("to"))
        joined = links.join(onward, links["root"] == onward["from"], "left")
        moved = stored(joined.select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "links")
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return links


def group_variants(words: DataFrame, times: int = 10, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n. words: word, n, each word once."""
    words = stored(words, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best")
    of = near_words(words, bucket).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    enough = -F.col("best.minus") >= times * F.col("n")
    met = words.join(of, "word", "left").select(
        "word",
        F.when(enough, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.minus")).alias("form_n"),
    )
    met = stored(met, "forms")
    last = roots(met.where("form is not null"))
    return met.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(word_counts(table(spark, sf_dir, "documents")))


#: Near words by equal deletions instead of segments; the checksum bit by bit, as DuckDB has none.
ORACLE = """
with recursive k(i, c, step) as (
  select i, i, 0 from range(256) t(i) union all
  select i, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, step + 1 from k where step < 8),
crc as (select list(c order by i) as t from k where step = 8),
runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents),
low as (
  select coalesce(cast(doc_id as varchar), '') as id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as times
  from runs where length(run) >= 7 group by all),
bytes as (select *, list_transform(range(1, len(hex(encode(id || ':' || run))) // 2 + 1), lambda p: cast(('0x' || substr(hex(encode(id || ':' || run)), 2 * p - 1, 2)) as bigint)) as b from low),
h as (select run, times, xor(list_reduce(b, lambda x, y: xor(x // 256, t[1 + xor(x % 256, y)]), 4294967295), 4294967295) as h from bytes, crc),
words as (
  select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, cast(sum(times) as bigint) as n
  from h group by 1 having sum(times) >= 2 and length(word) >= 7),
cut as (select word, n, p, left(word, p - 1) || substr(word, p + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as p from words)),
pairs as (
  select a.word, b.word as other, b.n as other_n from cut a join cut b on a.rest = b.rest and a.p = b.p and a.word <> b.word
  union select c.word, w.word, w.n from cut c join words w on w.word = c.rest
  union select w.word, c.word, c.n from cut c join words w on w.word = c.rest),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from pairs group by word),
forms as (
  select w.word, case when b.other_n >= 10 * w.n then b.other end as form, w.n, coalesce(n_near, 0) as n_near, case when b.other_n >= 10 * w.n then b.other_n end as form_n
  from words w left join best b using (word)),
walk(word, place, step) as (
  select word, word, 0 from forms union all
  select walk.word, forms.form, step + 1 from walk join forms on forms.word = walk.place where forms.form is not null)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from forms f join (select word, arg_max(place, step) as root from walk group by word) r using (word)
"""
