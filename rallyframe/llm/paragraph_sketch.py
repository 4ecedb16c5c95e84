"""Document fingerprints: an invertible Bloom lookup sketch of paragraphs.

A text is cut into paragraph pieces: lines, their sentences, and long stretches without a sentence end at words that a
rule on their letters picks, so that the cuts follow the content. Each piece's digest (repeats get digests of their
own) is put into three cells of a sketch: a count, the XOR of digests, the XOR of check values. The sketch of another
version is subtracted cell by cell; what both hold vanishes, and peeling cells with a single digest recovers the
digests that differ. If peeling stalls, both sketches are built again with four times the cells. The first size is the
least that holds an estimate of the difference, taken from the digests whose low bits are zero.

The fingerprint is the base sketch of 3 * BASE cells, in base64. Likeness of two: 1 - differing digests / digests of
both. A difference of more digests than the base sketch holds is peeled from larger sketches of the same texts;
edited_cells and next_cells tell how many cells gave each likeness, so the fingerprints alone lead to those of 3 * BASE.

`next document` is taken in descending doc_id order over the whole table without a single task: quantiles of doc_id
make ranges, the first row of each range also goes to the range before it, and sorted ranges are read as streams.

Cases: null text counts as empty; a text of white space only has no pieces; two texts without pieces have likeness 1;
rows with the same doc_id follow each other by the hash of their text, nulls in doc_id come last; a single row is its
own next document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordering import range_bounds, range_of
from .runtime import cut, ship, table

#: Cells of the base sketch in each of its three parts, and how much more a retry takes.
BASE, GROW, RETRIES = 8, 4, 10
LONG_PIECE = 160
SENTENCE = re.compile(r"(?<=[.!?]) ")
#: Documents and code points of texts that are worked on at once (a single text may be longer), and cells of sketches.
BATCH, BATCH_CHARS, CELLS = 200, 1 << 20, 1 << 19
#: One digest of so many, a power of two, is in the estimate of a difference; cells a digest that a sketch needs.
SAMPLED, ROOM = 16, 1.3


def paragraph_pieces(text: str) -> list[str]:
    out: list[str] = []
    for line in text.split("\n"):
        for piece in SENTENCE.split(line) if len(line) > 40 else (line,):
            if len(piece) <= LONG_PIECE:
                out.append(piece)
                continue
            start, words = 0, piece.split(" ")
            for i, w in enumerate(words, 1):
                if w and (ord(w[0]) * 31 + ord(w[-1]) * 7 + len(w)) % 8 == 0:
                    out.append(" ".join(words[start:i]))
                    start = i
            out.append(" ".join(words[start:]))
    return [p for p in out if p and not p.isspace()]


def digests(text: str) -> np.ndarray:
    """A 64-bit digest for each piece; the n-th repeat of a piece is hashed with seed n."""
    seen: dict[str, int] = {}
    out = []
    digest = xxhash.xxh3_64_intdigest
    for p in paragraph_pieces(text):
        n = seen[p] = seen.get(p, -1) + 1
        out.append(digest(p.encode("utf-8", "surrogatepass"), n))
    return np.array(out, dtype=np.uint64)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _checks(h: np.ndarray) -> np.ndarray:
    return (_mix(h, 99) >> np.uint64(32)).astype(np.uint32)


def _cells(h: np.ndarray, row: np.ndarray, size: int) -> list[np.ndarray]:
    """Flat cell numbers of digests in the three parts of their row's sketch; a size has hash functions of its own."""
    return [row * (3 * size) + j * size + (_mix(h, 3 * size + j) % np.uint64(size)).astype(np.int64) for j in range(3)]


class Sketches:
    """Sketches of equal size, a row each."""

    def __init__(self, rows: int, size: int) -> None:
        self.rows, self.size = rows, size
        self.count = np.zeros(rows * 3 * size, dtype=np.int32)
        self.keys = np.zeros(rows * 3 * size, dtype=np.uint64)
        self.checks = np.zeros(rows * 3 * size, dtype=np.uint32)

    def put(self, h: np.ndarray, row: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check = _checks(h)
        for at in _cells(h, row, self.size):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, h)
            np.bitwise_xor.at(self.checks, at, check)

    def minus(self, other: Sketches, mine: np.ndarray, theirs: np.ndarray) -> Sketches:
        """Row mine[i] less row theirs[i]."""
        out = Sketches(len(mine), self.size)
        for name, op in (("count", np.subtract), ("keys", np.bitwise_xor), ("checks", np.bitwise_xor)):
            a, b = getattr(self, name).reshape(self.rows, 3 * self.size), getattr(other, name).reshape(other.rows, 3 * self.size)
            setattr(out, name, op(a[mine], b[theirs]).ravel())
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows, digests and signs recovered, and whether each row came out empty. The cells are used up.

        A cell counts only if its digest belongs in it. A sketch that can be peeled is so after as many rounds as it
        has cells at most; there are no more.
        """
        rows, found, signs = [], [], []
        for _ in range(3 * self.size):
            one = np.flatnonzero(np.abs(self.count) == 1)
            h = self.keys[one]
            part = one // self.size % 3
            ok = _checks(h) == self.checks[one]
            for j in range(3):
                ok &= (part != j) | (_mix(h, 3 * self.size + j) % np.uint64(self.size) == (one % self.size).astype(np.uint64))
            one = one[ok]
            if not len(one):
                break
            row, h, sign = one // (3 * self.size), self.keys[one], self.count[one]
            order = np.lexsort((h, row))
            row, h, sign = row[order], h[order], sign[order]
            first = np.ones(len(row), dtype=bool)
            first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            row, h, sign = row[first], h[first], sign[first]
            self.put(h, row, -sign)
            rows.append(row)
            found.append(h)
            signs.append(sign)
        empty = ~((self.count != 0) | (self.keys != 0)).reshape(self.rows, 3 * self.size).any(axis=1)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        return join(rows, np.int64), join(found, np.uint64), join(signs, np.int32), empty

    def texts(self) -> list[str]:
        """Each row as base64: the counts (16 bit), digests (64 bit) and checks (32 bit) of its cells."""
        count, keys, checks = (x.reshape(self.rows, 3 * self.size) for x in (self.count.astype("<i2"), self.keys.astype("<u8"), self.checks.astype("<u4")))
        return [base64.b64encode(a.tobytes() + b.tobytes() + c.tobytes()).decode() for a, b, c in zip(count, keys, checks, strict=True)]


def _flat(sets: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the chosen sets, one behind the other, and their row."""
    chosen = [sets[i] for i in which.tolist()]
    sizes = [len(c) for c in chosen]
    return (np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.uint64)), np.repeat(np.arange(len(chosen)), sizes)


def sketch(sets: list[np.ndarray], which: np.ndarray, size: int) -> Sketches:
    out = Sketches(len(which), size)
    out.put(*_flat(sets, which))
    return out


def first_sizes(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The size at which each pair's sketches are subtracted first."""
    sampled = [s[s & np.uint64(SAMPLED - 1) == 0] for s in sets]
    (a, a_pair), (b, b_pair) = _flat(sampled, left), _flat(sampled, right)
    h, pair = np.concatenate([a, b]), np.concatenate([a_pair, b_pair])
    order = np.lexsort((h, pair))
    h, pair = h[order], pair[order]
    both = pair[1:][(pair[1:] == pair[:-1]) & (h[1:] == h[:-1])]  # a digest is once in a set
    differ = SAMPLED * (np.bincount(pair, minlength=len(left)) - 2 * np.bincount(both, minlength=len(left)))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    differ = np.minimum(np.maximum(differ, np.abs(sizes[left] - sizes[right])), sizes[left] + sizes[right])
    out = np.full(len(left), BASE)
    while (small := 3 * out < ROOM * differ).any():
        out[small] *= GROW
    return out


def differences(sets: list[np.ndarray], base: Sketches, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Of each pair of sets, the number of differing digests, the cells of the sketches that gave it (0: none did), and
    the digests only in the left and only in the right one (of a single pair). At most CELLS cells of sketches, or
    those of one pair, are held at once.
    """
    count, cells = np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64)
    digests_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    wanted = first_sizes(sets, left, right)
    pending = np.arange(len(left))
    for size in (BASE * GROW**k for k in range(RETRIES)):
        failed = []
        now = pending[wanted[pending] == size]
        step = max(1, CELLS // (3 * size))
        for some in (now[at : at + step] for at in range(0, len(now), step)):
            if size == BASE:
                diff = base.minus(base, left[some], right[some])
            else:
                a = sketch(sets, left[some], size)
                diff = a.minus(sketch(sets, right[some], size), np.arange(len(some)), np.arange(len(some)))
            rows, found, signs, empty = diff.peel()
            count[some[empty]] = np.bincount(rows, minlength=len(some))[empty]
            cells[some[empty]] = 3 * size
            for i in np.flatnonzero(empty).tolist() if len(left) == 1 else ():
                digests_of[int(some[i])] = (found[(rows == i) & (signs > 0)], found[(rows == i) & (signs < 0)])
            failed.append(some[~empty])
        if failed:
            wanted[np.concatenate(failed)] = size * GROW
        pending = pending[cells[pending] == 0]
        if not len(pending):
            break
    for i in pending.tolist():  # never met: by the sets themselves
        count[i] = len(np.setxor1d(sets[left[i]], sets[right[i]]))
    return count, cells, digests_of


def differing_paragraphs(old: str, new: str) -> tuple[set[int], set[int]]:
    """Digests of the paragraph pieces only in the old and only in the new version, recovered from sketches."""
    sets = [digests(old), digests(new)]
    _, _, found = differences(sets, sketch(sets, np.arange(2), BASE), np.array([0]), np.array([1]))
    only_old, only_new = found.get(0, (np.setdiff1d(sets[0], sets[1]), np.setdiff1d(sets[1], sets[0])))
    return set(only_old.tolist()), set(only_new.tolist())


def likeness(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 1 - count / np.maximum(total, 1), 1.0)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, part, edge: rows dealt to ranges; edge rows are the next range's first and end a range's stream."""
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    bounds = range_bounds(rows.select("doc_id", "tie"), "doc_id", "tie", ranges)
    rows = rows.withColumn("part", range_of("doc_id", "tie", bounds))
    # One row a range: the number of ranges bounds this window and the broadcast.
    firsts = rows.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("first"))
    over = Window.orderBy("part")
    to = F.coalesce(F.lead("part").over(over), F.first("part").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select(F.col("part").alias("own"), "first", to.alias("to"))
    joined = rows.join(F.broadcast(firsts), rows["part"] == firsts["own"])
    is_first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.tie") == F.col("tie"))
    places = F.when(is_first, F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("edge")), F.struct(F.col("to").alias("p"), F.lit(1).alias("edge")))).otherwise(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("edge"))))
    return joined.select("doc_id", "text", "tie", F.explode(places).alias("at")).select("doc_id", "text", "tie", F.col("at.p").alias("part"), F.col("at.edge").alias("edge"))


def _emit(rows: list[tuple], last_next: str) -> pa.RecordBatch:
    """rows: (doc_id, text) in order; the next text of each but the last is the following row's."""
    texts = [t for _, t in rows]
    following = [*texts[1:], last_next]
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, following, strict=True)]
    sets = [digests(t) for t in [*texts, last_next, *edited]]
    n = len(rows)
    base = sketch(sets, np.arange(len(sets)), BASE)
    printed = base.texts()
    left = np.concatenate([np.arange(n), np.arange(n)])
    right = np.concatenate([np.arange(n) + n + 1, np.arange(1, n + 1)])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    count, cells, _ = differences(sets, base, left, right)
    near = likeness(count, sizes[left] + sizes[right])
    sha = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]
    columns = {
        "doc_id": pa.array([i for i, _ in rows], pa.int64()),
        "n_chars": pa.array(list(map(len, texts)), pa.int64()),
        "edited_sha256": pa.array(sha, pa.string()),
        "fingerprint": pa.array(printed[:n], pa.string()),
        "edited_fingerprint": pa.array(printed[n + 1 :], pa.string()),
        "near_edited": pa.array(near[:n], pa.float64()),
        "near_next": pa.array(near[n:], pa.float64()),
        "edited_cells": pa.array(cells[:n], pa.int64()),
        "next_cells": pa.array(cells[n:], pa.int64()),
    }
    return pa.record_batch(list(columns.values()), names=list(columns))


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside its edited version's and the likeness to that and to the next document."""
    ship(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs).repartition(parts, "part").sortWithinPartitions("part", "edge", F.desc_nulls_last("doc_id"), F.desc("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        now, ended, chars = None, False, 0
        for whole in batches:
            for batch in cut(whole, BATCH):
                for doc_id, text, part, edge in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if part != now:
                        now, ended = part, False
                    if ended:
                        continue
                    if edge or len(waiting) >= BATCH or (waiting and chars >= BATCH_CHARS):
                        yield _emit(waiting, text)
                        waiting, chars, ended = [], 0, bool(edge)
                        if edge:
                            continue
                    waiting.append((doc_id, text))
                    chars += len(text)

    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_cells long, next_cells long"
    return rows.select("doc_id", "text", "part", "edge").mapInArrow(run, kind)


def op4_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(table(spark, sf_dir, "documents"))
