"""Line deduplication by a sharded minimal perfect hash.

Lines' keys are hashed to 128 bits and counted by documents. The distinct hashes that enough documents hold are dealt
to shards; each shard becomes a minimal perfect hash (a cascade of bit arrays: a hash alone in its place of a level
stays there, the others go to the next) that leads to three flat arrays: fingerprint (the other 64 bits of the hash),
document count, largest doc_id. Documents probe these arrays and are not joined with lines: a hash outside the index
lands on some place too, but its fingerprint differs.

Up to INDEX_BYTES, a size that is known before, the arrays are broadcast and a document is filtered where it is read.
A larger index stays distributed: probes are dealt by shard and salt, each shard's arrays precede its probes in the
sorted partition, and the hits go back to their documents. A shard has as many salts as the documents that hold its
lines ask for, so a line of very many documents is probed in many tasks. Keys of a shard that agree in 64 bits of their
hashes, if any, are kept beside the perfect hash and told apart by all 128.

Rule: a key is the line without the ASCII white space `[ \\t\\n\\x0b\\f\\r]` at both ends, A-Z lower-cased. Keys of at least
`min_chars` code points in at least `min_docs` documents lose all their lines, except in the document with the largest
doc_id that holds the key.

Cases: null and empty texts have one empty line, which stays; a text whose lines all go becomes empty; rows with the
same doc_id count as one document; a null doc_id counts as a document but is never the largest; an empty table gives
an empty result; other columns pass through `dedup_lines` unchanged, but for those with the names of its counts.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .runtime import columns, free_name, map_batches, quoted, schema_of, ship, stored, table

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of a shard on average, places per key in a level of the cascade.
SHARD_KEYS, SPREAD = 50_000, 1.6
#: An index of at most so many bytes is broadcast.
INDEX_BYTES = 32 << 20
#: Bytes of the index per key, at most: the arrays and the cascade's bits.
KEY_BYTES = 24
BLANK = b" \t\n\x0b\x0c\r"
#: Documents that hold lines of a shard, counted for each line, for each of its salts.
PROBES = 2_000_000


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The key of each line, None where it is too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip(BLANK) if len(line) >= min_chars else b""
        if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars):
            out.append(None)
        else:
            out.append(key)
    return out


def hashed(key: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(key))


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal: n hashes get the ranks 0 to n-1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest
        self.before, total = [], 0
        self.words = []
        for bits in levels:
            words = np.packbits(bits, bitorder="little").view(np.uint8)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
            self.words.append(words)
            self.before.append(counts + total)
            total += int(counts[-1])
        self.total = total

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        """h: distinct hashes."""
        levels, left = [], h
        while len(left) and len(levels) < 24:
            size = int(np.ceil(max(64, len(left) * SPREAD) / 64)) * 64
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def rank(self, h: np.ndarray) -> np.ndarray:
        """Ranks of hashes; those outside get some rank or -1."""
        out = np.full(len(h), -1)
        open_ = np.arange(len(h))
        for level, (bits, words, before) in enumerate(zip(self.levels, self.words, self.before, strict=True)):
            if not len(open_):
                return out
            at = (_mix(h[open_], level) % np.uint64(len(bits))).astype(np.int64)
            found = bits[at]
            hit = at[found]
            below = words[hit >> 3] & ((1 << (hit & 7)) - 1).astype(np.uint8)
            out[open_[found]] = before[hit >> 3] + np.bitwise_count(below)
            open_ = open_[~found]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, h[open_]), len(self.rest) - 1)
            same = self.rest[at] == h[open_]
            out[open_[same]] = self.total + at[same]
        return out


class Shard:
    """A perfect hash with its arrays, to and from bytes."""

    def __init__(self, ph: PerfectHash, prints: np.ndarray, counts: np.ndarray, largest: np.ndarray, beside: tuple[np.ndarray, ...]) -> None:
        """beside: hashes, fingerprints, counts and largest ids of keys whose hashes agree."""
        self.ph, self.prints, self.counts, self.largest, self.beside = ph, prints, counts, largest, beside

    @classmethod
    def build(cls, h: np.ndarray, prints: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> Shard:
        counts = counts.astype(np.int32)
        _, where, times = np.unique(h, return_inverse=True, return_counts=True)
        alone = times[where] == 1
        ph = PerfectHash.build(h[alone])
        place = np.flatnonzero(alone)[np.argsort(ph.rank(h[alone]))]
        return cls(ph, prints[place], counts[place], largest[place], tuple(x[~alone] for x in (h, prints, counts, largest)))

    def probe(self, h: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each hash is in the index, its document count and its largest doc_id."""
        rank = self.ph.rank(h)
        found = rank >= 0
        found[found] = self.prints[rank[found]] == prints[found]
        counts, largest = np.zeros(len(h), dtype=np.int32), np.zeros(len(h), dtype=np.int64)
        counts[found], largest[found] = self.counts[rank[found]], self.largest[rank[found]]
        for one, print_, count, most in zip(*(x.tolist() for x in self.beside), strict=True):
            same = (h == np.uint64(one)) & (prints == print_)
            found |= same
            counts[same], largest[same] = count, most
        return found, counts, largest

    def to_bytes(self) -> bytes:
        parts = [np.packbits(b, bitorder="little").tobytes() for b in self.ph.levels]
        parts += [x.tobytes() for x in (self.ph.rest, self.prints, self.counts, self.largest, *self.beside)]
        return struct.pack("<I", len(self.ph.levels)) + b"".join(struct.pack("<Q", len(p)) + p for p in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        (n,), at, parts = struct.unpack_from("<I", raw), 4, []
        while at < len(raw):
            (size,) = struct.unpack_from("<Q", raw, at)
            parts.append(raw[at + 8 : at + 8 + size])
            at += 8 + size
        levels = [np.unpackbits(np.frombuffer(p, dtype=np.uint8), bitorder="little").astype(bool) for p in parts[:n]]
        kinds = (np.uint64, np.int64, np.int32, np.int64)
        rest, prints, counts, largest, *beside = (np.frombuffer(p, dtype=k) for p, k in zip(parts[n:], (*kinds, *kinds), strict=True))
        return cls(PerfectHash(levels, rest), prints, counts, largest, tuple(beside))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, h, print: each countable key of a document once."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, hs, prints = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for key in {k for k in line_keys(text, min_chars) if k is not None}:
                h, p = hashed(key)
                ids.append(doc_id)
                hs.append(h)
                prints.append(p)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(prints, pa.int64())], names=["doc_id", "h", "print"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, h long, print long")


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """h, print, n_docs, largest: the keys in enough documents."""
    each = line_hashes(docs, min_chars).groupBy("h", "print", "doc_id").agg(F.lit(1).alias("one"))
    return each.groupBy("h", "print").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("largest")).where(F.col("n_docs") >= min_docs).withColumn("largest", F.coalesce("largest", F.lit(-(1 << 63))))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(h, 63) % np.uint64(shards)).astype(np.int64)


def build_index(frequent: DataFrame, shards: int) -> DataFrame:
    """shard, body, salts: one row a shard that has keys."""
    ship(frequent.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = shard_of(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), shards)
            yield pa.record_batch([*b.columns, pa.array(at)], names=[*b.schema.names, "shard"])

    def build(t: pa.Table) -> pa.Table:
        h, prints, counts, largest = (t[c].to_numpy() for c in ("h", "print", "n_docs", "largest"))
        body = Shard.build(h.view(np.uint64), prints, counts, largest).to_bytes()
        salts = 1 + int(counts.sum()) // PROBES
        return pa.table({"shard": t["shard"][:1], "body": pa.array([body], pa.binary()), "salts": pa.array([salts], pa.int64())})

    dealt = frequent.mapInArrow(deal, "h long, print long, n_docs long, largest long, shard long")
    return dealt.groupBy("shard").applyInArrow(build, "shard long, body binary, salts long")


class Index:
    """All shards at once."""

    def __init__(self, shards: int, bodies: dict[int, bytes]) -> None:
        self.shards, self.parts = shards, {s: Shard.from_bytes(b) for s, b in bodies.items()}

    def probe(self, h: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, counts, largest = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        at = shard_of(h, self.shards)
        for s in np.unique(at).tolist():
            if part := self.parts.get(s):
                mine = at == s
                found[mine], counts[mine], largest[mine] = part.probe(h[mine], prints[mine])
        return found, counts, largest


def _hits(batch: pa.RecordBatch, index: Index, min_chars: int) -> list[set[int]]:
    """Line numbers to drop of each row; doc_id and text are the first two columns."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    rows, lines, hs, prints = [], [], [], []
    for row, text in enumerate(texts):
        for n, key in enumerate(line_keys(text, min_chars)):
            if key is not None:
                h, p = hashed(key)
                rows.append(row)
                lines.append(n)
                hs.append(h)
                prints.append(p)
    drop: list[set[int]] = [set() for _ in texts]
    if rows:
        found, _, largest = index.probe(np.array(hs, dtype=np.int64).view(np.uint64), np.array(prints, dtype=np.int64))
        for i in np.flatnonzero(found).tolist():
            if ids[rows[i]] != largest[i]:
                drop[rows[i]].add(lines[i])
    return drop


def _filtered(texts: list[str | None], drop: list[set[int]]) -> tuple[list, list, list]:
    kept, n_lines, n_dropped = [], [], []
    for text, gone in zip(texts, drop, strict=True):
        lines = (text or "").split("\n")
        n_lines.append(len(lines))
        n_dropped.append(len(gone))
        kept.append("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text)
    return kept, n_lines, n_dropped


def _result(batch: pa.RecordBatch, drop: list[set[int]], names: list[str], digests: bool, count_names: tuple[str, str]) -> pa.RecordBatch:
    kept, n_lines, n_dropped = _filtered(batch.column(1).to_pylist(), drop)
    counts = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
    if digests:
        sha = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in kept]
        return pa.record_batch([batch.column(0), *counts, pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
    return pa.record_batch([batch.column(0), pa.array(kept, pa.string()), *batch.columns[2 : len(names)], *counts], names=[*names, *count_names])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, digests: bool = False, index_bytes: int = INDEX_BYTES, count_names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """All columns with the text that stays, and the counts of lines and of those dropped, under `count_names`.

    With `digests`, doc_id, n_lines, n_dropped and kept_sha256 instead.
    """
    spark = docs.sparkSession
    frequent = stored(frequent_lines(docs, min_chars, min_docs), "frequent_lines")
    n = frequent.count()
    shards = max(1, -(-n // SHARD_KEYS))
    bodies = stored(build_index(frequent, shards), "line_index")
    names = ["doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text", *count_names)]]
    result = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" if digests else schema_of(docs, names, **dict.fromkeys(count_names, LongType()))
    rows = docs.select("doc_id", "text") if digests else docs.select(*columns(names))
    if n * KEY_BYTES + 4096 * shards <= index_bytes:
        given = spark.sparkContext.broadcast({r["shard"]: bytes(r["body"]) for r in bodies.toLocalIterator()})
        cache: list[Index] = []

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if not cache:
                cache.append(Index(shards, given.value))
            yield _result(batch, _hits(batch, cache[0], min_chars), names, digests, count_names)

        return map_batches(rows, run, result)
    hits = routed_hits(docs, bodies, shards, min_chars)
    of_text, lines = free_name(rows, "hash_of_text"), free_name(rows, "lines_to_drop")
    hits = hits.select(F.col("__doc"), F.col("__hash"), F.col("__lines").alias(lines))
    rows = rows.withColumn(of_text, F.xxhash64("text"))
    joined = rows.join(hits, rows["doc_id"].eqNullSafe(hits["__doc"]) & (rows[of_text] == hits["__hash"]), "left").select(*[rows[quoted(c)] for c in rows.columns if c != of_text], hits[quoted(lines)])

    def late(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        drop = [set(x or []) for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield _result(batch, drop, names, digests, count_names)

    return map_batches(joined, late, result)


def routed_hits(docs: DataFrame, bodies: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """__doc, __hash (of the text), __lines: what to drop, found where the shards' arrays are."""
    salts = np.ones(shards, dtype=np.uint64)  # a number for each of SHARD_KEYS lines of the index
    for r in bodies.where("salts > 1").select("shard", "salts").toLocalIterator():
        salts[r["shard"]] = r["salts"]

    def probes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc_id, text, of_text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for n, key in enumerate(line_keys(text, min_chars)):
                if key is not None:
                    out.append((doc_id, of_text, n, *hashed(key)))
        if out:
            cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            shard = shard_of(cols[3].to_numpy().view(np.uint64), shards)
            salt = (_mix(cols[1].to_numpy(zero_copy_only=False).view(np.uint64), 7) % salts[shard]).astype(np.int64)
            yield pa.record_batch([*cols, pa.array(shard), pa.array(salt), pa.nulls(len(out), pa.binary())], names=["__doc", "__hash", "line", "h", "print", "shard", "salt", "body"])

    kind = "__doc long, __hash long, line long, h long, print long, shard long, salt long, body binary"
    asked = map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("t")), probes, kind)
    given = bodies.selectExpr("cast(null as long) __doc", "cast(null as long) __hash", "-1L line", "0L h", "0L print", "shard", "explode(sequence(0L, salts - 1L)) salt", "body")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.unionByName(given).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "line")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, None
        for batch in batches:
            doc, of_text, line, h, prints, shard, salt, body = batch.columns
            lines = line.to_numpy()
            starts = np.flatnonzero(lines < 0).tolist()
            for a, b in zip([0, *[s + 1 for s in starts]], [*starts, batch.num_rows], strict=True):
                if a and lines[a - 1] < 0:
                    now, part = (shard[a - 1].as_py(), salt[a - 1].as_py()), Shard.from_bytes(body[a - 1].as_py())
                if a == b or part is None:
                    continue
                mine = (shard.slice(a, b - a).to_numpy() == now[0]) & (salt.slice(a, b - a).to_numpy() == now[1])
                found, _, largest = part.probe(h.slice(a, b - a).to_numpy().view(np.uint64), prints.slice(a, b - a).to_numpy())
                ids = doc.slice(a, b - a)
                other = np.array([x != y for x, y in zip(ids.to_pylist(), largest.tolist(), strict=True)], dtype=bool)
                keep = pa.array(found & mine & other)
                yield pa.record_batch([ids.filter(keep), of_text.slice(a, b - a).filter(keep), line.slice(a, b - a).filter(keep)], names=["__doc", "__hash", "line"])

    found = dealt.mapInArrow(probe, "__doc long, __hash long, line long")
    return found.groupBy("__doc", "__hash").agg(F.collect_set("line").alias("__lines"))  # repeated rows probe alike


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), digests=True)


ORACLE = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as n
  from documents),
k as (
  select doc_id, n, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l),
f as (
  select key, max(doc_id) as largest from k where length(key) >= 40
  group by key having count(distinct doc_id) >= 5),
d as (
  select k.doc_id, k.n, k.line, f.key is not null and k.doc_id <> f.largest as gone
  from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (where not gone), '')) as kept_sha256
from d group by doc_id
"""
