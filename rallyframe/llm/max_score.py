"""Exact top k by inner product with MaxScore over sharded postings.

A component is a term with a sign: the postings of (component, sign) hold the vectors whose integer there has that sign,
with its size. A query's terms are its components with the same sign as the posting, so what they add to a score is
positive, and what the other sign takes off only lowers it. Vectors are dealt to shards of SHARD rows; a shard's task gets its vectors
and then the queries in blocks, sorted, so that a shard and a block are in memory at a time and both spill on their way.
In a shard a query bounds each of its terms by the largest posting, sees its strongest postings to have a first
threshold (the k-th best of some exact scores), and splits its terms: the weakest whose bounds together stay below the threshold are
non-essential, as no vector without an essential term can reach it. The postings of essential terms are traversed, then
the non-essential components of what they found are probed one after another, and a vector is dropped as soon as what
is left cannot lift it to the threshold. The k best of every shard are merged.

Every query must meet every shard, so the work is the number of queries times that of vectors; the queries are moved
once a shard.

Cases: vectors that are null or hold a null or non-finite component, or one beyond LARGEST, take no part; a missing
component (vectors of different lengths, an empty vector) adds nothing; a null vec_id is no query and after all others
in ties; rows that repeat a vec_id are queries of their own, and only the query's own row is no candidate; with fewer
than k candidates all are given; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import ship, stored, table

#: Vectors of a shard.
SHARD = 8192
#: Queries that reach a shard in one row.
BLOCK = 256
#: Largest size of a component, so that scores of some thousand components fit into 64 bits.
LARGEST = 1 << 17
#: Terms and postings of each that give a query its first threshold.
SEED_TERMS, SEED_POSTINGS = 8, 16
#: The rank of a row without a vec_id among equal scores.
LAST = (1 << 63) - 1

_IN = "shard int, kind int, block long, ids binary, rows binary, sizes binary, cells binary"
_OUT = "query_row long, query_id long, row long, vec_id long, score long"


class Shard:
    """The postings and vectors of one shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        """values: vectors by components, missing ones zero."""
        order = np.lexsort((rows, ids))  # ties by place: the smaller vec_id is the smaller index
        self.ids, self.rows, self.values = ids[order], rows[order], np.ascontiguousarray(values[order])
        self.columns = np.ascontiguousarray(self.values.T)
        self.postings: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for d, column in enumerate(self.columns):
            for sign in (1, -1):
                at = np.flatnonzero(column * sign > 0)
                at = at[np.argsort(-column[at] * sign, kind="stable")]  # the largest first
                self.postings[d, sign] = at, column[at] * sign

    def search(self, own_row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and scores of the k best vectors but the query's own row, in no order."""
        n, wide = self.values.shape
        query = np.pad(query[:wide], (0, max(0, wide - len(query))))
        skip = np.flatnonzero(self.rows == own_row)
        terms = [(int(d), 1 if query[d] > 0 else -1) for d in np.flatnonzero(query)]
        bounds = np.array([abs(int(query[d])) * int(self.postings[d, s][1][0]) if len(self.postings[d, s][0]) else 0 for d, s in terms], np.int64)
        by = np.argsort(-bounds, kind="stable")
        terms, bounds = [terms[i] for i in by], bounds[by]
        left = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0]])  # what terms i, i+1, ... can add
        least = self._seed(query, terms, skip, k)
        if least is None or least <= 0:  # a vector without any term may be among the best
            essential, found = len(terms), np.arange(n)
            scores = np.zeros(n, np.int64)
        else:
            essential = int(np.searchsorted(-left, -least, side="right"))  # the first i with left[i] < least
            scores = np.zeros(n, np.int64)
            for d, s in terms[:essential]:
                at, sizes = self.postings[d, s]
                scores[at] += sizes * abs(int(query[d]))
            found = np.flatnonzero(scores + left[essential] >= least)  # none of no essential posting
            scores = scores[found]
        found, scores = (x[~np.isin(found, skip)] for x in (found, scores))
        if least is None or least <= 0:
            return self._best(found, self.values[found] @ query, k)
        for d, s in terms[:essential]:  # what components of the other sign take off
            scores += np.minimum(self.columns[d][found] * s, 0) * abs(int(query[d]))
        for i, (d, _) in enumerate(terms[essential:], essential):
            open_ = scores + left[i] >= least
            found, scores = found[open_], scores[open_]
            scores = scores + self.columns[d][found] * int(query[d])
        return self._best(found[scores >= least], scores[scores >= least], k)

    def _seed(self, query: np.ndarray, terms: list[tuple[int, int]], skip: np.ndarray, k: int) -> int | None:
        """The k-th best exact score of the strongest postings' vectors: no better than that of the shard."""
        some = [self.postings[t][0][:SEED_POSTINGS] for t in terms[:SEED_TERMS]]
        seen = np.setdiff1d(np.concatenate(some), skip) if some else np.empty(0, np.int64)
        if len(seen) < k:
            return None
        return int(np.partition(self.values[seen] @ query, len(seen) - k)[len(seen) - k])

    @staticmethod
    def _best(found: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.lexsort((found, -scores))[:k]
        return found[best], scores[best]


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """row, vec_id, v (floor(scale * x) for each component), of the vectors that take part; a table."""
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    kept = kept.where(F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & (F.abs(x) <= LARGEST)))
    whole = F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("int"))
    return stored(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("v")), "integer_vectors")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Up to `size` rows in one: ids, rows, sizes (of the vectors), cells, as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column("vec_id").fill_null(LAST).to_numpy(zero_copy_only=False)
                cells = part.column("v")
                made = (ids.astype("<i8"), part.column("row").to_numpy().astype("<i8"), np.diff(cells.offsets.to_numpy()).astype("<i4"), cells.flatten().to_numpy(zero_copy_only=False).astype("<i4"))
                yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in made], names=["ids", "rows", "sizes", "cells"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, "ids binary, rows binary, sizes binary, cells binary")


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, rows, values of packed rows, shorter vectors filled with zeros."""
    ids, rows = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rows"], "<i8")
    sizes, cells = np.frombuffer(row["sizes"], "<i4"), np.frombuffer(row["cells"], "<i4").astype(np.int64)
    values = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
    values[np.arange(values.shape[1]) < sizes[:, None]] = cells
    return ids, rows, values


def _stacked(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = max(p[2].shape[1] for p in parts)
    filled = [np.pad(p[2], ((0, 0), (0, wide - p[2].shape[1]))) for p in parts]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(filled)


def shard_best(vectors: DataFrame, k: int, every: int, shard_rows: int, block: int) -> DataFrame:
    """query_row, query_id, row, vec_id, score: the k best of each shard for each query.

    Queries are the vectors whose vec_id `every` divides.
    """
    spark = vectors.sparkSession
    shards = max(1, -(-vectors.count() // shard_rows))
    parts = max(1, min(shards, 20_000))
    held = _packed(vectors, 64).select(F.lit(0).alias("kind"), F.monotonically_increasing_id().alias("block"), "*")
    held = held.select(F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("shard"), "*")
    asked = stored(_packed(vectors.where(F.col("vec_id") % every == 0), block), "query_blocks")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), F.monotonically_increasing_id().alias("block"), "ids", "rows", "sizes", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts_, shard = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["shard"] != now:
                    now, parts_, shard = row["shard"], [], None
                if row["kind"] == 0:
                    parts_.append(_unpacked(row))
                    continue
                if shard is None and parts_:
                    shard, parts_ = Shard(*_stacked(parts_)), []
                if shard is not None:
                    yield _answers(shard, _unpacked(row), k)

    ship(spark)
    both = held.unionByName(asked).repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", "kind", "block")
    return both.mapInArrow(run, _OUT)


def _answers(shard: Shard, queries: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> pa.RecordBatch:
    out: list[tuple[np.ndarray, ...]] = []
    for query_id, query_row, query in zip(*queries, strict=True):
        found, scores = shard.search(int(query_row), query, k)
        out.append((np.full(len(found), query_row), np.full(len(found), query_id), shard.rows[found], shard.ids[found], scores))
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 5
    return pa.record_batch([pa.array(c) for c in columns], names=["query_row", "query_id", "row", "vec_id", "score"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard_rows: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k vectors with the largest inner product, ties to smaller vec_ids."""
    found = shard_best(integer_vectors(vectors, scale), k, every, shard_rows, block)
    best = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    ranked = found.withColumn("rank", best).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") < LAST, F.col("vec_id")).alias("vec_id"), "score")


def op13_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
