"""Vector compression by product codes: weighted Lloyd over the distinct integer parts of each position.

Components become integers, vectors are cut into equal consecutive parts, and equal parts of a position become one row
with a weight. Lloyd's rounds run over these rows: a round assigns each to the nearest entry of its position's codebook
and gives back a sum and a count an entry from every task, whatever the number of vectors; the codebooks (parts x
entries rows, a fixed number) are all that the driver holds. The last assignment gives every distinct part its code and
its error, which are joined back to the vectors. Parts that more than one in HEAVY vectors hold, of which there are at
most HEAVY a position, are joined by broadcast, all others by a shuffle.

Sums and distances are whole numbers without rounding.

Cases: a vector that is null or holds a null or non-finite component is dropped; one of another length than most (of the
lengths that can be cut; ties to the longer), or with a component beyond LARGEST, has no code and no error but stays a
row; a null vec_id is after all others; equal vec_ids follow their parts, and repeated rows stay repeated; null labels
are one label; a sum of errors too large for a long is null; with fewer vectors than entries the codebooks are shorter;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, map_batches, ship, stored, table

#: Largest size of an integer component, so that a vector's error fits into 64 bits.
LARGEST = 1 << 27
#: A part that one in so many vectors holds is joined by broadcast.
HEAVY = 1024
#: Parts that are compared with a codebook at once.
ROWS = 4096


@dataclass
class Codec:
    """books: for each position an array of entries by components."""

    books: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position within the part, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def _finite(vector: str) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def integer_parts(vectors: DataFrame, parts: int = 4, scale: int = 1024) -> DataFrame:
    """row, vec_id, label, parts (floor(scale * x) cut into `parts` lists; null where a vector can't be cut), as a table."""
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & _finite("v"))
    lengths = kept.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).where((F.col("n") > 0) & (F.col("n") % parts == 0))
    common = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    length = common["n"] if common else 0
    fits = (F.size("v") == length) & F.forall("v", lambda x: F.abs(x) <= LARGEST / scale)
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("int"))
    each = length // parts
    pieces = F.array(*[F.slice("whole", 1 + i * each, each) for i in range(parts)])
    cast = kept.withColumn("whole", F.when(fits if length else F.lit(False), whole))
    rows = cast.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.when(F.col("whole").isNotNull(), pieces).alias("parts"))
    return stored(rows, "vectors")


def _exploded(vectors: DataFrame) -> DataFrame:
    return vectors.where("parts is not null").select("row", "vec_id", "label", F.posexplode("parts").alias("position", "part"))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry, ties to the lower index; exact."""
    kind = np.float64 if max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0)) ** 2 * parts.shape[1] < 1 << 50 else np.int64
    codes, far = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    entries = book.astype(kind)
    own = (entries * entries).sum(axis=1)
    for at in range(0, len(parts), ROWS):
        rows = parts[at : at + ROWS].astype(kind)
        squares = (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ entries.T) + own
        best = squares.argmin(axis=1)
        codes[at : at + ROWS] = best
        far[at : at + ROWS] = squares[np.arange(len(rows)), best]
    return codes, far


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _sums(distinct: DataFrame, books: list[np.ndarray]) -> list[dict[int, tuple[int, list[int]]]]:
    """For each position: entry to the weight of its parts and the sums of their components."""
    entries, width = len(books[0]), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(books), entries, width), dtype=object)
        counts = np.zeros((len(books), entries), dtype=np.int64)
        for batch in (part for whole in batches for part in cut(whole, ROWS)):
            position, weight = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("position", "weight"))
            values = _matrix(batch.column("part"))
            for p in np.unique(position).tolist():
                own, by = values[position == p], weight[position == p]
                codes, _ = nearest(own, books[p])
                exact = np.int64 if int(by.max()) * int(np.abs(own).max(initial=0)) * len(own) < 1 << 62 else object
                some = np.zeros((entries, width), dtype=exact)
                np.add.at(some, codes, own.astype(exact) * by[:, None].astype(exact))
                sums[p] += some.astype(object)
                np.add.at(counts[p], codes, by)
        p, e = np.nonzero(counts)
        digits = pa.array([[str(x) for x in s] for s in sums[p, e]], pa.list_(pa.string()))
        yield pa.record_batch([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), digits], names=["position", "entry", "n", "sums"])

    ship(distinct.sparkSession)
    each = distinct.mapInArrow(run, "position int, entry int, n long, sums array<string>")
    by = each.select("position", "entry", "n", F.posexplode("sums").alias("i", "s")).groupBy("position", "entry", "i")
    found: list[dict] = [{} for _ in books]
    for r in by.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # parts x entries x width rows
        found[r["position"]].setdefault(r["entry"], (r["n"], [0] * width))[1][r["i"]] = int(r["s"])
    return found


def fit(vectors: DataFrame, distinct: DataFrame, entries: int = 256, rounds: int = 4) -> Codec:
    """Codebooks that start as the parts of the smallest vec_ids; a round that changes nothing is the last."""
    first = vectors.where("parts is not null").select("vec_id", "parts").orderBy(F.asc_nulls_last("vec_id"), "parts").limit(entries).collect()
    if not first:
        return Codec([])
    books = [np.array([r["parts"][p] for r in first], dtype=np.int64) for p in range(len(first[0]["parts"]))]
    for _ in range(rounds):
        after = [book.copy() for book in books]
        for p, found in enumerate(_sums(distinct, books)):
            for e, (n, sums) in found.items():
                after[p][e] = [s // n for s in sums]
        if all(np.array_equal(a, b) for a, b in zip(books, after, strict=True)):
            break
        books = after
    return Codec(books)


def _coded_parts(distinct: DataFrame, codec: Codec) -> DataFrame:
    """The distinct parts with code and distance."""
    books = codec.books

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        position, values = batch.column("position").to_numpy(zero_copy_only=False), _matrix(batch.column("part"))
        codes, far = np.empty(len(position), np.int64), np.empty(len(position), np.int64)
        for p in np.unique(position).tolist():
            own = position == p
            codes[own], far[own] = nearest(values[own], books[p])
        yield pa.record_batch([*batch.columns, pa.array(codes.astype(np.int32)), pa.array(far)], names=["position", "part", "weight", "code", "distance"])

    return stored(map_batches(distinct, run, "position int, part array<int>, weight long, code int, distance long", ROWS), "coded_parts")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codec]:
    """vec_id, label, code (an index a part, two hex digits each), error, label_error; and the codebooks. At most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    rows = integer_parts(vectors, parts, scale)
    distinct = stored(_exploded(rows).groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")), "parts")
    codec = fit(rows, distinct, entries, rounds)
    uncoded = rows.where("parts is null").select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not codec.books:
        return uncoded.withColumn("label_error", F.lit(None).cast("long")), codec
    coded = _coded_parts(distinct, codec)
    common = rows.where("parts is not null").count() / HEAVY
    heavy, light = coded.where(F.col("weight") > common).drop("weight"), coded.where(F.col("weight") <= common).drop("weight")
    seen = _exploded(rows).join(F.broadcast(heavy), ["position", "part"], "left")  # at most parts x HEAVY rows
    names = ("row", "vec_id", "label", "position", "code", "distance")
    rest = seen.where("code is null").drop("code", "distance").join(light, ["position", "part"])
    of_rows = seen.where("code is not null").select(*names).unionByName(rest.select(*names)).groupBy("row", "vec_id", "label")
    digits = [F.max(F.when(F.col("position") == p, F.lower(F.lpad(F.hex("code"), 2, "0")))) for p in range(parts)]
    whole = of_rows.agg(F.concat(*digits).alias("code"), F.sum("distance").alias("error")).drop("row")
    whole = stored(whole.unionByName(uncoded), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    of_labels = whole.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "same")
    return whole.join(of_labels, F.col("label").eqNullSafe(F.col("same")), "left").drop("same"), codec


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codec = compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(codec.digest()).alias("codebooks_sha256"))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """DuckDB SQL of the query: all parts against all entries, a step a round."""
    near = (
        "select d.position, d.part, d.weight, arg_min(b.entry, list_sum(list_transform(list_zip(d.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 1000 + b.entry) as code, "
        "min(list_sum(list_transform(list_zip(d.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as distance from d join {book} b on b.position = d.position group by all"
    )
    steps = [
        f"v as (select row_number() over (order by vec_id) as row, vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as w "
        "from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"e as (select row, vec_id, label, position, w[1 + position * len(w) // {parts} : (position + 1) * len(w) // {parts}] as part from v, (select unnest(range({parts})) as position))",
        "d as (select position, part, count(*) as weight from e group by all)",
        f"b0 as (select position, row - 1 as entry, part from e where row <= {entries})",
    ]
    for k in range(rounds):
        steps += [
            f"n{k} as ({near.format(book=f'b{k}')})",
            f"m{k} as (select position, code, i, cast(floor_div as bigint) as x from (select position, code, i, (sum(part[i] * weight) - ((sum(part[i] * weight) % sum(weight)) + sum(weight)) % sum(weight)) // sum(weight) as floor_div "
            f"from (select position, code, part, weight, unnest(range(1, len(part) + 1)) as i from n{k}) group by position, code, i))",
            f"b{k + 1} as (select b.position, b.entry, coalesce(u.part, b.part) as part from b{k} b left join (select position, code, list(x order by i) as part from m{k} group by all) u on u.position = b.position and u.code = b.entry)",
        ]
    steps += [
        f"n{rounds} as ({near.format(book=f'b{rounds}')})",
        f"h as (select sha256(string_agg(array_to_string(part, ','), ',' order by position, entry)) as codebooks_sha256 from b{rounds})",
        f"r as (select vec_id, label, row, string_agg(lpad(lower(to_hex(code)), 2, '0'), '' order by position) as code, cast(sum(distance) as bigint) as error from e join n{rounds} using (position, part) group by all)",
    ]
    return f"with {', '.join(steps)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from r, h"


ORACLE = oracle()
