"""Ordered rules over streams whose rows come out of order: rows wait until the watermark has passed them, and are then taken by time.

The streams need the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` =
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from segmill.operators.dedup import DROP_C, DROP_P, MERGE_C, MERGE_P

ORIGIN = 86_400.0  # event time of second 0 of a timeline: a watermark starts at 0, and what is not above it is late


class InOrder(StatefulProcessor):
    """Hands a timeline's rows on in order, as soon as the watermark has passed them.

    Waiting rows are (micros, values...) in a list state.  A timer stands at the earliest of them; when it goes off, all rows up to the watermark
    are complete, since Spark drops what comes later, and go to :meth:`take`.  So the state holds the rows between the watermark
    and the latest one, and what ``take`` keeps.  Input rows whose micros are -1 only make their timeline known.
    """

    columns = "micros long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.columns.split(", ")]
        self.waiting = handle.getListState("waiting", self.columns)

    def seen(self, key: tuple) -> pd.DataFrame | None:
        """Rows to give out when a timeline has input."""

    def take(self, key: tuple, rows: list[tuple]) -> pd.DataFrame | None:
        """Rows to give out for the next rows of a timeline."""

    def idle(self, key: tuple, watermark: int) -> pd.DataFrame | None:
        """Rows to give out when a timer went off and all rows up to the watermark were taken."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        new = [r for pdf in rows for r in pdf.loc[pdf["micros"] >= 0, self.names].itertuples(index=False, name=None)]
        if new:
            self.waiting.appendList(new)
            self._wake(new)
        out = self.seen(key)
        if out is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, left = sorted((r for r in rows if r[0] <= passed), key=lambda r: r[1:]), [r for r in rows if r[0] > passed]
        if ready:
            if left:
                self.waiting.put(left)
                self._wake(left)
            else:
                self.waiting.clear()
            out = self.take(key, ready)
            if out is not None and len(out):
                yield out
        out = self.idle(key, passed)
        if out is not None and len(out):
            yield out

    def _wake(self, rows: list[tuple]) -> None:
        self.handle.registerTimer(-(-min(r[0] for r in rows) // 1000))


class MinGap(InOrder):
    """The strict minimum gap, counted from a first stamp at 0."""

    columns = "micros long, t double"

    def __init__(self, key: str, time: str, gap: float):
        self.key, self.time, self.gap = key, time, gap

    def init(self, handle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "t double")

    def _out(self, key: tuple, times: list[float]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(times), self.time: np.array(times, float)})

    def seen(self, key):
        if self.last.exists():
            return None
        self.last.update((0.0,))
        return self._out(key, [0.0])

    def take(self, key, rows):
        last, kept = self.last.get()[0], []
        for _, t in rows:
            if t - last > self.gap:
                last = t
                kept.append(t)
        self.last.update((last,))
        return self._out(key, kept)


class MergeDropNew(InOrder):
    """The merge/drop/new rule.  A segment is given out when it can no longer grow: when another one opens, a repeat closes it, or its timeline is idle."""

    columns = "micros long, t double, dur double, p long, c long"

    def __init__(self, key: str, idle_seconds: float):
        self.key, self.idle_micros = key, int(idle_seconds * 1_000_000)

    def init(self, handle) -> None:
        super().init(handle)
        self.accepted = handle.getListState("accepted", "p long, c long")
        self.segment = handle.getValueState("segment", "open boolean, seg long, t double, dur double, parts long, p long, c long, latest long")

    def _out(self, key: tuple, segments: list[tuple]) -> pd.DataFrame:
        seg, t, dur, parts = zip(*segments, strict=True) if segments else ((),) * 4
        return pd.DataFrame({self.key: [key[0]] * len(seg), "seg": np.array(seg, np.int64), "t": np.array(t, float), "dur": np.array(dur, float), "parts": np.array(parts, np.int64)})

    def take(self, key, rows):
        seen = np.array([tuple(r) for r in self.accepted.get()] if self.accepted.exists() else [], np.int64).reshape(-1, 2).view(np.uint64)
        size = old = len(seen)
        seen = np.concatenate([seen, np.zeros((len(rows), 2), np.uint64)])
        is_open, seg, t0, dur0, parts, p0, c0, latest = self.segment.get() if self.segment.exists() else (False, -1, 0.0, 0.0, 0, 0, 0, rows[0][0])
        closed = []
        for micros, t, dur, p, c in rows:
            if micros - latest > self.idle_micros:
                closed += [(seg, t0, dur0, parts)] if is_open else []
                is_open, seg, size, old = False, -1, 0, 0
                self.accepted.clear()
            latest = micros
            if is_open and _distance(p, p0) <= MERGE_P and _distance(c, c0) <= MERGE_C:
                dur0, parts = dur0 + dur, parts + 1
                continue
            closed += [(seg, t0, dur0, parts)] if is_open else []
            own = np.array([p, c], np.int64).view(np.uint64)
            bits = np.bitwise_count(seen[:size] ^ own)
            is_open = not ((bits[:, 0] <= DROP_P) & (bits[:, 1] <= DROP_C)).any()
            if is_open:
                seen[size] = own
                size += 1
                seg, t0, dur0, parts, p0, c0 = seg + 1, t, dur, 1, p, c
        if size > old:
            self.accepted.appendList([tuple(r) for r in seen[old:size].view(np.int64).tolist()])
        self.segment.update((is_open, seg, t0, dur0, parts, p0, c0, latest))
        return self._out(key, closed)

    def idle(self, key, watermark):
        if not self.segment.exists():
            return None
        is_open, seg, t, dur, parts, *_, latest = self.segment.get()
        if watermark < latest + self.idle_micros:
            self.handle.registerTimer(-(-(latest + self.idle_micros) // 1000))
            return None
        self.segment.clear()
        self.accepted.clear()
        return self._out(key, [(seg, t, dur, parts)] if is_open else [])


def _distance(a: int, b: int) -> int:
    return ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count()


def _stamped(rows: DataFrame, time: str, late: str, counts: Column) -> DataFrame:
    """Rows with an event time that carries the watermark, and its microseconds (-1 unless ``counts``)."""
    t = F.col(time).cast("double")
    stamped = rows.withColumn("event", F.timestamp_seconds(F.coalesce(t, F.lit(1e-6)) + ORIGIN)).withWatermark("event", late)
    return stamped.withColumn("t", t).withColumn("micros", F.when(counts & t.isNotNull(), F.unix_micros("event")).otherwise(-1))


def stream_cuts(rows: DataFrame, gap: float, threshold: float, late: str = "10 seconds", key: str = "video_id", time: str = "pts_time", score: str = "scene") -> DataFrame:
    """(key, time): 0 for each timeline, then the times above the threshold that lie more than ``gap`` after the last kept one.

    Rows may come out of order by up to ``late``, measured over all timelines; once the watermark has passed a time, the cuts up to it are those of
    the table (``boundaries.detected``).  Rows that come later than that are dropped.  The state of a timeline is its last kept time and the
    rows that the watermark has not passed.  Times are seconds, above -86,400; rows without a time only make their timeline known, if that is not late.
    """
    kind = rows.schema[key].dataType.simpleString()
    stamped = _stamped(rows, time, late, F.col(score) > threshold).select(key, "event", "micros", "t")
    return stamped.groupBy(key).transformWithStateInPandas(MinGap(key, time, gap), f"{key} {kind}, {time} double", "append", "EventTime")


def stream_segments(candidates: DataFrame, late: str = "10 seconds", idle: float = 3600.0, key: str = "video_id") -> DataFrame:
    """key, seg, t, dur, parts of what candidates(key, t, dur, p, c) leave by the merge/drop/new rule (``dedup.merge_drop_new``).

    Rows may come out of order by up to ``late``.  A timeline is over ``idle`` seconds after its latest candidate: once the watermark is there, its open
    segment is given out and its state goes, and a later candidate begins anew with segment 0.  Candidates without a time, duration or hash change nothing.  The state
    of a timeline is the open segment, the hashes of its segments, and the rows that the watermark has not passed.
    """
    kind = candidates.schema[key].dataType.simpleString()
    whole = candidates.where("t is not null and dur is not null and p is not null and c is not null")
    stamped = _stamped(whole, "t", late, F.lit(True)).select(key, "event", "micros", "t", F.col("dur").cast("double").alias("dur"), F.col("p").cast("long").alias("p"), F.col("c").cast("long").alias("c"))
    return stamped.groupBy(key).transformWithStateInPandas(MergeDropNew(key, idle), f"{key} {kind}, seg long, t double, dur double, parts long", "append", "EventTime")
