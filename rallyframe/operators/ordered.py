"""Work that depends on all rows of a key before, as a step from a small state and the next rows to the state after.

The same step runs over a table, with rows streamed in order through a task, and over a stream (streaming/live.py), with
the state kept between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Rows = list[tuple]


def numbered(df: DataFrame, keys: list[str], stretch: Column, order: list[str], name: str) -> DataFrame:
    """The rows with their place (0, 1, ...) in the order of their key.

    `stretch` never falls in that order, so a stretch is a unit of work, and the rows before it are summed from one row a stretch.
    """
    rows = df.withColumn("_stretch", stretch)
    unit = [*keys, "_stretch"]
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    before = rows.groupBy(*unit).agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(c).alias(f"_b{c}") for c in unit], F.coalesce(earlier.cast("long"), F.lit(0).cast("long")).alias("_before"))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*unit).orderBy(*order)))
    same = [placed[c].eqNullSafe(before[f"_b{c}"]) for c in unit]
    return placed.join(before, same).select(*df.columns, (F.col("_before") + F.col("_place") - 1).alias(name))


def islands(df: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """The rows with `island` (1, 2, ... along frame_idx): between two islands of a key are more than `gap` frames without a row.

    Frames are cut into stretches of gap + 1; an empty one ends an island. The order is that of one row a stretch.
    """
    rows = df.withColumn("_place", F.floor(F.col("frame_idx") / (gap + 1)))
    w = Window.partitionBy(*keys).orderBy("_place")
    begins = F.coalesce((F.col("_place") - F.lag("_place").over(w) > 1).cast("long"), F.lit(1).cast("long"))
    used = rows.select(*keys, "_place").distinct().withColumn("_begins", begins)
    named = used.select(*[F.col(c).alias(f"_b{c}") for c in [*keys, "_place"]], F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    same = [rows[c].eqNullSafe(named[f"_b{c}"]) for c in [*keys, "_place"]]
    return rows.join(named, same).select(*df.columns, "island")


class Stepper(Protocol):
    columns: tuple[str, ...]  # what a row is made of
    order: tuple[str, ...]  # by which rows come, frame_idx first; rows of one frame come together
    state: str  # the state's schema
    out: str  # the schema of what it gives, without the keys

    def begin(self) -> tuple:
        """The state before the first row."""

    def step(self, state: tuple, rows: Rows) -> tuple[tuple, Rows]:
        """The state after the rows and what they give; rows are cut anywhere between frames."""


def plain(value):
    """NaN and missing values of pandas as None, numpy's numbers as Python's."""
    if value is None or value is pd.NA or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


def tuples(rows: pd.DataFrame, columns: tuple[str, ...]) -> Rows:
    return [tuple(plain(v) for v in row) for row in rows[list(columns)].astype(object).itertuples(index=False)]


def out_schema(df: DataFrame, keys: list[str], stepper: Stepper) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), stepper.out])


def in_order(df: DataFrame, keys: list[str], stepper: Stepper) -> DataFrame:
    """The keys and what the stepper gives. A batch of rows and a state are in memory at a time, however long a key is."""
    names = [f.name for f in StructType.fromDDL(out_schema(df, keys, stepper)).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, waiting = None, None, []
        for batch in batches:
            found: Rows = []
            for key, row in zip(tuples(batch, tuple(keys)), tuples(batch, stepper.columns), strict=True):
                if waiting and (key != now or row[0] != waiting[-1][0]):  # a frame is never cut
                    if len(waiting) >= 512 or key != now:
                        state, out = stepper.step(state, waiting)
                        found += [(*now, *r) for r in out]
                        waiting = []
                if key != now:
                    now, state = key, stepper.begin()
                waiting.append(row)
            if found:
                yield pd.DataFrame(found, columns=names, dtype=object)
        if waiting:
            _, out = stepper.step(state, waiting)
            if out:
                yield pd.DataFrame([(*now, *r) for r in out], columns=names, dtype=object)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(*keys, *stepper.columns).repartition(parts, *keys).sortWithinPartitions(*keys, *stepper.order)
    return ordered.mapInPandas(run, out_schema(df, keys, stepper))
