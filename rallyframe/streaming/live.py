"""Analysis of matches that are still being played.

Rows may come late and in any order within the watermark's delay. A key's rows wait in its state until the watermark has
passed them and are then worked on in order, so the results are those of the whole table, however the stream is cut
and wherever it is begun again. What is later than the watermark is dropped. State: the waiting rows, at most those of the
delay, and the stepper's own.

Keys with rows in most frames (`live_dense`) get them packed, a stretch of frames as one value, as Spark hands single rows
over at a cost of its own; their state is a value a stretch, so one stretch is in memory at a time, however many wait.

The session needs the RocksDB state store; `use_state_store` sets it.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from ..config import DEFAULT, Thresholds
from ..functions.geometry import distance
from ..operators.ordered import Rows, Stepper, out_schema
from ..operators.tracking import TrackRules, TrackStepper
from ..storage import shared_dir

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def frame_time(frame: str = "frame_idx") -> Column:
    """A frame counts as a second, from the first on, as a stream's watermark begins at 0 and what isn't above it is late."""
    return F.timestamp_seconds(F.col(frame) + 1)


def _millis(frame: int) -> int:
    return (frame + 1) * 1000


class KalmanStepper(Stepper):
    """The filter of operators/smoothing.py, a row at a time. Rows that wait for the first seen position are at most max_gap."""

    columns = ("frame_idx", "x_px", "y_px", "confidence")
    order = ("frame_idx",)
    state = "mean array<double>, spread array<double>, misses long, frames array<long>"
    out = "frame_idx long, x_px double, y_px double, confidence double"

    def __init__(self, max_gap: int = DEFAULT.max_gap, t: Thresholds = DEFAULT) -> None:
        self.max_gap, self.t = max_gap, t

    def begin(self) -> tuple:
        return [], [self.t.kalman_p0, 0.0, self.t.kalman_p0], 0, []

    def step(self, state: tuple, rows: Rows) -> tuple[tuple, Rows]:
        frame, *values = zip(*rows, strict=True) if rows else [()] * 4
        state, out = self.step_columns(state, [np.array(frame, np.int64), *(np.array(v, float) for v in values)])
        return state, [tuple(None if v != v else v for v in row) for row in zip(*(column.tolist() for column in out), strict=True)]

    def step_columns(self, state: tuple, columns: list[np.ndarray]) -> tuple[tuple, list[np.ndarray]]:
        """As `step`, by columns; NaN is none."""
        frame, x, y, conf = columns
        max_gap, r, q, fill = self.max_gap, self.t.kalman_r, self.t.kalman_q, self.t.fill_confidence
        mean, (a, b, c), misses, waiting = [float(v) for v in state[0]], (float(v) for v in state[1]), int(state[2]), [int(f) for f in state[3]]
        hidden = np.isnan(x) | np.isnan(y)
        xs, ys, conf = np.where(hidden, np.nan, x).tolist(), np.where(hidden, np.nan, y).tolist(), conf.copy()
        if not mean:
            lead = int(hidden.argmin()) if not hidden.all() else len(hidden)
            wait = min(lead, max(0, max_gap - misses))
            for _ in range(lead):
                a, b, c = a + 2 * b + c + q, b + c, c + q
            misses, waiting = misses + lead, waiting + frame[:wait].tolist()
            if lead == len(hidden):
                return ([], [a, b, c], misses, waiting), [frame[wait:], *(np.full(lead - wait, np.nan) for _ in range(2)), conf[wait:]]
            mean, n = [xs[lead], ys[lead], 0.0, 0.0], len(waiting)
            before = [np.r_[np.array(waiting, frame.dtype), frame[wait:lead]], *(np.r_[np.full(n, v), np.full(lead - wait, np.nan)] for v in mean[:2]), np.r_[np.full(n, fill), conf[wait:lead]]]
            state, out = self.step_columns((mean, [a, b, c], misses, []), [v[lead:] for v in columns])
            return state, [np.r_[p, q] for p, q in zip(before, out, strict=True)]
        px, py, vx, vy = mean
        filled = []
        for i, zx in enumerate(xs):
            a, b, c = a + 2 * b + c + q, b + c, c + q
            px += vx
            py += vy
            if zx == zx:
                s = a + r
                k0, k1 = a / s, b / s
                rx, ry, left = zx - px, ys[i] - py, 1 - k0
                px += k0 * rx
                py += k0 * ry
                vx += k1 * rx
                vy += k1 * ry
                a, b, c, misses = left * a, left * b, c - k1 * b, 0
                xs[i], ys[i] = px, py
            else:
                misses += 1
                if misses <= max_gap:
                    xs[i], ys[i] = px, py
                    filled.append(i)
        conf[filled] = fill
        return ([px, py, vx, vy], [a, b, c], misses, waiting), [frame, np.array(xs, float), np.array(ys, float), conf]


class DedupStepper(Stepper):
    """An event is kept if it is `dedup_gap` frames or more after the last one kept."""

    columns = ("frame_idx", "x", "y", "track_id", "confidence")
    order = ("frame_idx", "x", "y", "track_id", "confidence")
    state = "last long"
    out = "frame_idx long, x double, y double, track_id int, confidence double"

    def __init__(self, t: Thresholds = DEFAULT) -> None:
        self.t = t

    def begin(self) -> tuple:
        return (None,)

    def step(self, state: tuple, rows: Rows) -> tuple[tuple, Rows]:
        last, out = state[0], []
        for row in rows:
            if last is None or row[0] - last >= self.t.dedup_gap:
                last = row[0]
                out.append(row)
        return (last,), out


class StepsStepper(Stepper):
    """Visible rows with the steps before and after, once both are known and the match has `min_visible` of them."""

    columns = ("frame_idx", "x_px", "y_px")
    order = ("frame_idx",)
    state = "seen long, held array<double>"
    out = "frame_idx long, x double, y double, vx0 double, vx1 double, vy0 double, vy1 double"

    def __init__(self, t: Thresholds = DEFAULT) -> None:
        self.t = t

    def begin(self) -> tuple:
        return 0, []

    def step(self, state: tuple, rows: Rows) -> tuple[tuple, Rows]:
        seen, flat, out = int(state[0]), list(state[1]), []
        held = [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]
        for row in rows:
            if row[1] is None or row[2] is None:
                continue
            seen += 1
            held.append((float(row[0]), row[1], row[2]))
            if seen < self.t.min_visible:
                continue
            for p, (f, x, y), n in zip(held, held[1:], held[2:], strict=False):
                out.append((int(f), x, y, x - p[1], n[1] - x, y - p[2], n[2] - y))
            held = held[-2:]
        return (seen, [v for row in held for v in row]), out


#: Rows that are stepped over, and kept as one value of the state, at a time.
ROWS = 4096


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _parts(rows: pa.Table) -> Iterator[pa.Table]:
    for at in range(0, rows.num_rows, ROWS):
        yield rows.slice(at, ROWS)


def _values(column: pa.ChunkedArray) -> list:
    """A column's values; NaN is None too."""
    if pa.types.is_floating(column.type):
        known = column.to_numpy()
        values = known.tolist()
        for i in np.flatnonzero(np.isnan(known)):
            values[i] = None
        return values
    return column.to_pylist() if column.null_count or not pa.types.is_integer(column.type) else column.to_numpy().tolist()


def _tuples(rows: pa.Table) -> Rows:
    return list(zip(*(_values(column) for column in rows.columns), strict=True))


class _Ordered(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, then steps over them in order."""

    def __init__(self, keys: list[str], stepper: Stepper) -> None:
        self.keys, self.stepper = keys, stepper
        self.names = [*keys, *(f.name for f in StructType.fromDDL(stepper.out).fields)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")  # a batch's rows as one Arrow stream
        self.kept = handle.getValueState("kept", self.stepper.state)

    def _arm(self, first: int) -> None:
        """One timer a key: at the first waiting row."""
        timers = list(self.handle.listTimers())
        if not timers or first < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if len(batch):
                self.waiting.appendValue((_packed(pa.Table.from_pandas(batch[list(self.stepper.columns)], preserve_index=False)),))
                at = int(batch[self.stepper.columns[0]].min())
                first = at if first is None else min(first, at)
        if first is not None:
            self._arm(_millis(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = pa.concat_tables([pa.ipc.open_stream(r[0]).read_all() for r in self.waiting.get()], promote_options="permissive")
        frame = self.stepper.columns[0]
        due = pc.less_equal(rows[frame], now // 1000 - 1)  # _millis(frame) <= now
        later = rows.filter(pc.invert(due))
        self.waiting.clear()
        if later.num_rows:
            self.waiting.put([(_packed(part),) for part in _parts(later)])
            self.handle.registerTimer(_millis(int(pc.min(later[frame]).as_py())))
        state = yield from self._over(key, self._state(), rows.filter(due))
        self.kept.update(state)

    def _state(self) -> tuple:
        return tuple(self.kept.get()) if self.kept.exists() else self.stepper.begin()

    def _over(self, key, state: tuple, rows: pa.Table) -> Generator[pd.DataFrame, None, tuple]:
        """Steps over the rows in order, some at a time."""
        order, waiting = pc.sort_indices(rows, [(c, "ascending") for c in self.stepper.order], null_placement="at_start"), []
        for at in range(0, len(order), ROWS):
            out: Rows = []
            waiting += _tuples(rows.take(order[at : at + ROWS]))
            end = len(waiting)
            if at + ROWS < len(order):  # a frame is never cut
                while end and waiting[end - 1][0] == waiting[-1][0]:
                    end -= 1
            if end:
                state, out = self.stepper.step(state, waiting[:end])
                waiting = waiting[end:]
            if out:
                yield pd.DataFrame([(*key, *r) for r in out], columns=self.names, dtype=object)
        return state

    def close(self) -> None:
        pass


#: Frames whose rows are packed, and kept as one value of the state.
BLOCK = 32_768


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """So many rows at a time, as each of Spark's batches alone would cut a stretch into several packs."""
    waiting, n = [], 0
    for batch in batches:
        waiting, n = [*waiting, batch], n + batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, n = [], 0
    if n:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def _packs(batches: Iterator[pa.RecordBatch], keys: list[str], stepper: Stepper) -> Iterator[pa.RecordBatch]:
    """The keys, block, first and last (frames) and rows: one row a key and stretch of frames in what is gathered."""
    frame = stepper.columns[0]
    for batch in _gathered(batches, 2 * BLOCK):
        frames = batch.column(frame).to_numpy()
        codes = [frames // BLOCK, *(batch.column(k).dictionary_encode("encode").indices.to_numpy() for k in keys)]
        order = np.lexsort((frames, *codes))
        cut = np.flatnonzero(np.any([np.diff(c[order]) != 0 for c in codes], axis=0)) + 1
        begins, ends, table = np.r_[0, cut], np.r_[cut, len(order)], pa.Table.from_batches([batch]).take(order)
        head, rows = table.select(keys).take(begins), table.select(list(stepper.columns))
        places = [pa.array(v, pa.int64()) for v in (codes[0][order[begins]], frames[order[begins]], frames[order[ends - 1]])]
        packs = pa.array([_packed(rows.slice(a, b - a)) for a, b in zip(begins, ends, strict=True)], pa.binary())
        yield from pa.table([*head.columns, *places, packs], names=[*keys, "block", "first", "last", "rows"]).to_batches()


def _blocks(rows: DataFrame, keys: list[str], stepper: Stepper) -> DataFrame:
    """The rows as `_packs`; a row without a frame has no time and is left out."""
    kind = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "block long, first long, last long, rows binary"])
    frame = F.col(stepper.columns[0]).cast("long").alias(stepper.columns[0])
    return rows.select(*keys, frame, *stepper.columns[1:]).where(F.col(stepper.columns[0]).isNotNull()).mapInArrow(lambda batches: _packs(batches, keys, stepper), kind)


def _unpacked(packs: bytes) -> pa.Table:
    """The rows of one or more Arrow streams, one behind the other."""
    source, found = pa.BufferReader(packs), []
    while source.tell() < len(packs):
        found.append(pa.ipc.open_stream(source).read_all())
    return pa.concat_tables(found)


class _Blocks(_Ordered):
    """As above, for packed rows, which wait by their stretch of frames.

    Spark drops a pack whose last row is late; others lose the rows that the watermark had passed when the key was last seen.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block long", "rows binary")
        self.kept = handle.getValueState("kept", self.stepper.state)
        self.passed = handle.getValueState("passed", "frame long")  # the last frame that the watermark had passed

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        passed, first = self.passed.get()[0] if self.passed.exists() else None, None
        for packs in rows:
            for block, begin, pack in zip(packs["block"], packs["first"], packs["rows"], strict=True):
                if passed is not None and begin <= passed:
                    own = _unpacked(bytes(pack))
                    own = own.filter(pc.greater(own[self.stepper.columns[0]], passed))
                    if not own.num_rows:
                        continue
                    begin, pack = pc.min(own[self.stepper.columns[0]]).as_py(), _packed(own)
                at = (int(block),)
                before = self.waiting.getValue(at) if self.waiting.containsKey(at) else (b"",)
                self.waiting.updateValue(at, (bytes(before[0]) + bytes(pack),))
                first = int(begin) if first is None else min(first, int(begin))
        self.passed.update((timerValues.getCurrentWatermarkInMs() // 1000 - 1,))
        if first is not None:
            self._arm(_millis(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = timerValues.getCurrentWatermarkInMs() // 1000 - 1  # _millis(last) <= the watermark
        state = self._state()
        for block in sorted(int(k[0]) for k in self.waiting.keys()):
            if block * BLOCK > last:
                self.handle.registerTimer(_millis(block * BLOCK))
                break
            rows = _unpacked(bytes(self.waiting.getValue((block,))[0]))
            due = pc.less_equal(rows[self.stepper.columns[0]], last)
            later = rows.filter(pc.invert(due))
            if later.num_rows:
                self.waiting.updateValue((block,), (_packed(later),))
            else:
                self.waiting.removeKey((block,))
            state = yield from self._over(key, state, rows.filter(due))
            if later.num_rows:
                self.handle.registerTimer(_millis(pc.min(later[self.stepper.columns[0]]).as_py()))
                break
        self.kept.update(state)
        self.passed.update((last,))

    def _over(self, key, state: tuple, rows: pa.Table) -> Generator[pd.DataFrame, None, tuple]:
        """A stepper with `step_columns` takes a stretch at once."""
        if not hasattr(self.stepper, "step_columns"):
            return (yield from super()._over(key, state, rows))
        rows = rows.sort_by([(c, "ascending") for c in self.stepper.order])
        state, out = self.stepper.step_columns(state, [column.to_numpy() for column in rows.columns])
        if len(out[0]):
            yield pd.DataFrame({name: np.array([v] * len(out[0])) if i < len(key) else v for i, (name, v) in enumerate(zip(self.names, [*key, *out], strict=True))})
        return state


def live(stream: DataFrame, keys: list[str], stepper: Stepper, watermark: str = "120 seconds") -> DataFrame:
    """The keys and what the stepper gives, from a stream with the keys and the stepper's columns."""
    use_state_store(stream.sparkSession)
    timed = stream.select(*keys, *stepper.columns, frame_time().alias("at")).withWatermark("at", watermark)
    return timed.groupBy(*keys).transformWithStateInPandas(_Ordered(keys, stepper), out_schema(timed, keys, stepper), "Append", "EventTime")


def live_dense(stream: DataFrame, keys: list[str], stepper: Stepper, watermark: str = "120 seconds") -> DataFrame:
    """As `live`, for keys with rows in most frames."""
    use_state_store(stream.sparkSession)
    timed = _blocks(stream, keys, stepper).select(*keys, "block", "first", "rows", frame_time("last").alias("at")).withWatermark("at", watermark)
    return timed.groupBy(*keys).transformWithStateInPandas(_Blocks(keys, stepper), out_schema(timed, keys, stepper), "Append", "EventTime")


def live_kalman(ball: DataFrame, watermark: str = "120 seconds", max_gap: int = DEFAULT.max_gap, t: Thresholds = DEFAULT) -> DataFrame:
    """What `kalman_smooth` gives; the first rows of a match come when its ball has been seen."""
    return live_dense(ball, ["match_id"], KalmanStepper(max_gap, t), watermark)


def live_dedup(events: DataFrame, watermark: str = "120 seconds", t: Thresholds = DEFAULT) -> DataFrame:
    """What `dedup_events` gives."""
    return live(events, ["match_id", "type"], DedupStepper(t), watermark)


def live_steps(ball: DataFrame, watermark: str = "120 seconds", t: Thresholds = DEFAULT) -> DataFrame:
    """The inner rows of `enough_visible(differences)`, without court positions."""
    return live_dense(ball, ["match_id"], StepsStepper(t), watermark)


def live_tracks(boxes: DataFrame, watermark: str = "120 seconds", rules: TrackRules | None = None) -> DataFrame:
    """What `track_boxes` gives."""
    return live_dense(boxes, ["match_id"], TrackStepper(rules), watermark)


def live_hits(peaks: DataFrame, players: DataFrame, calibrated: bool = True, watermark: str = "120 seconds", t: Thresholds = DEFAULT) -> DataFrame:
    """What `hits` gives, from a stream of peaks (match_id, frame_idx, x, y, cx, cy) and one of players.

    A stream-stream join over an interval of frames; both sides leave the state when the watermark has passed the
    interval. The nearest player is chosen once the watermark has passed the peak.
    """
    p = peaks.select("match_id", "frame_idx", "x", "y", "cx", "cy", frame_time().alias("at")).withWatermark("at", watermark)
    names = [c for c in ("frame_idx", "track_id", "det_seq", "foot_x_px", "foot_y_px", "foot_x_m", "foot_y_m")]
    q = players.select(F.col("match_id").alias("r_match_id"), *[F.col(c).alias(f"r_{c}") for c in names], frame_time().alias("r_at")).withWatermark("r_at", watermark)
    near = F.expr(f"match_id = r_match_id and r_at >= at - interval {t.nearest_radius} seconds and r_at <= at + interval {t.nearest_radius} seconds")
    places = ("r_foot_x_m", "r_foot_y_m", "cx", "cy") if calibrated else ("r_foot_x_px", "r_foot_y_px", "x", "y")
    joined = p.join(q, near).withColumn("dist", distance(*[F.col(c) for c in places]))
    gap = F.col("r_frame_idx") - F.col("frame_idx")
    order = F.struct(F.abs(gap).alias("gap"), F.when(gap < 0, 1).otherwise(0).alias("back"), "dist", "r_det_seq")
    best = F.min_by(F.struct("r_track_id", "dist", "x", "y"), order).alias("b")
    found = joined.groupBy("match_id", "frame_idx", "at").agg(best).where(F.col("b.dist") < (t.hit_m if calibrated else t.hit_px))
    return found.select("match_id", "frame_idx", F.lit("hit").alias("type"), "b.x", "b.y", F.col("b.r_track_id").alias("track_id"), F.lit(t.hit_confidence).alias("confidence"))


def replay(table: DataFrame, operator: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """A live operator over a whole table, as a stream that ends: what it gives, as a table.

    A row far behind the last frame lets the watermark pass all others. Rows are written by stretches of frames, so packs are full.
    """
    spark, folder = table.sparkSession, shared_dir(table.sparkSession)
    table.repartition(*keys, F.floor(F.col("frame_idx") / BLOCK)).sortWithinPartitions(*keys, "frame_idx").write.parquet(f"{folder}/in/rows")
    end = spark.read.schema(table.schema).parquet(f"{folder}/in/rows").agg(F.coalesce(F.max("frame_idx"), F.lit(0)).alias("frame_idx")).select((F.col("frame_idx") + 1_000_000).alias("frame_idx"))
    kinds = {f.name: f.dataType for f in table.schema.fields}
    marks = [F.lit("-1" if c in keys else None).cast(kinds[c]).alias(c) if c != "frame_idx" else F.col(c).cast(kinds[c]).alias(c) for c in table.columns]
    end.select(*marks).write.parquet(f"{folder}/in/end")
    out = operator(spark.readStream.schema(table.schema).parquet(f"{folder}/in/*"))
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").where(F.col(keys[0]).cast("string") != "-1")
