"""Sharding by fixed virtual slots (native: DataFrame operations only).

Records hash by doc_id, checksum and size into a fixed number of slots, so neither a doc_id nor a text that very many
rows share fills a slot. Bytes and rows are summed per slot, and a slot-to-shard map is
kept as a versioned table: version 0 deals slots out round robin, and each later version holds the edits of a
rebalancing of the one before, also over runs and for more shards, where a stored map is given. Rows never move one by
one; only map entries change. The map has as many entries as there are slots, whatever the corpus, so the driver plans
it.

Cases: null text has no bytes and the checksum of the empty text; a null doc_id hashes like any other key; repeated
rows share a slot and each get a place of their own (ties by checksum, then size); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import shared_dir, stored, table

SLOTS = 4096
ROW_OVERHEAD = 16


def slot_records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot: what planning needs of a record, without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return known.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def first_map(slots: int, shards: int) -> list[int]:
    return [slot % shards for slot in range(slots)]


def rebalance(slot_map: list[int], sizes: list[int], shards: int) -> list[int]:
    """Edit the map until no single slot can move from the heaviest to the lightest shard and narrow their gap."""
    edited, loads = list(slot_map), [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(edited):
        loads[shard] += sizes[slot]
        if sizes[slot]:
            held[shard].append((sizes[slot], slot))
    for own in held:
        own.sort()
    heavy = [(-load, shard) for shard, load in enumerate(loads)]
    light = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heavy)
    heapq.heapify(light)
    for _ in range(8 * len(slot_map)):
        while -heavy[0][0] != loads[heavy[0][1]]:
            heapq.heappop(heavy)
        while light[0][0] != loads[light[0][1]]:
            heapq.heappop(light)
        top, low = heavy[0][1], light[0][1]
        gap = loads[top] - loads[low]
        own = held[top]
        at = bisect.bisect_right(own, (gap // 2, len(slot_map)))
        near = [i for i in (at - 1, at) if 0 <= i < len(own) and own[i][0] < gap]
        if not near:
            break
        size, slot = own.pop(min(near, key=lambda i: abs(gap - 2 * own[i][0])))
        bisect.insort(held[low], (size, slot))
        edited[slot] = low
        for shard, change in ((top, -size), (low, size)):
            loads[shard] += change
            heapq.heappush(heavy, (-loads[shard], shard))
            heapq.heappush(light, (loads[shard], shard))
    return edited


def _map_rows(spark: SparkSession, entries: list[dict]) -> DataFrame:
    kind = "array<struct<slot:int,shard:int,first:bigint,bytes:bigint,rows:bigint>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(entries)), kind)).alias("e")).select("e.*")


def _entries(slot_map: list[int], totals: dict[int, tuple[int, int]], shards: int) -> list[dict]:
    """first: the place in its shard of a slot's first row, counted over the shard's slots in ascending order."""
    seen, out = [0] * shards, []
    for slot, shard in enumerate(slot_map):
        size, rows = totals.get(slot, (0, 0))
        out.append({"slot": slot, "shard": shard, "first": seen[shard], "bytes": size, "rows": rows})
        seen[shard] += rows
    return out


def latest_map(spark: SparkSession, path: str, slots: int) -> tuple[int, list[int]] | None:
    """The last version of a stored map and its shards in the order of slots; None where there is none."""
    try:
        stored_map = spark.read.parquet(path)
    except AnalysisException:
        return None
    version = stored_map.agg(F.max("version").alias("v")).first()["v"]
    rows = stored_map.where(F.col("version") == version).orderBy("slot").select("slot", "shard").collect()  # `slots` rows
    if [r["slot"] for r in rows] != list(range(slots)):
        raise ValueError(f"the map in {path} is not one of {slots} slots")
    return version, [r["shard"] for r in rows]


def plan_map(records: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> tuple[str, int]:
    """Write the next version of the slot-to-shard map, a folder of its own; the map's path and that version.

    Without a map in `path` (by default a new folder) versions 0 and 1 are written. A version has `slots` rows.
    """
    spark = records.sparkSession
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    totals = {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in sums}
    path = path or f"{shared_dir(spark)}/slot_map"
    write = lambda version, entries: _map_rows(spark, entries).coalesce(1).write.parquet(f"{path}/version={version}")
    before = latest_map(spark, path, slots)
    if before is None:
        before = 0, first_map(slots, shards)
        write(0, _entries(before[1], totals, shards))
    version, current = before
    if max(current) >= shards:
        raise ValueError(f"the map in {path} has more than {shards} shards")
    edited = rebalance(current, [totals.get(s, (0, 0))[0] for s in range(slots)], shards)
    write(version + 1, _entries(edited, totals, shards))
    return path, version + 1


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every record with its shard, its place there (gapless from 0) and the virtual slot that decided.

    With `map_path`, the map stored there by an earlier run is edited for these documents and this number of shards.
    """
    spark = docs.sparkSession
    records = stored(slot_records(docs, slots), "slot_records")
    path, version = plan_map(records, shards, slots, map_path)
    latest = spark.read.parquet(f"{path}/version={version}")  # a fixed number of rows, hence the broadcast
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    placed = records.withColumn("place", place)
    return placed.join(F.broadcast(latest), placed["virtual_slot"] == latest["slot"], "inner").select(
        "doc_id",
        placed["size"],
        "text_crc32",
        F.lit("bytes").alias("law"),
        latest["shard"],
        (latest["first"] + placed["place"] - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(version).alias("map_version"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)
