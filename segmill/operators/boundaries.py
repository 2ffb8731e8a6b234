"""Boundaries on ordered timelines.

The column functions work on sorted arrays of times, one per timeline, so a plan needs a single shuffle by timeline for any
number of them.  State is the last *kept* time, which a window frame cannot carry; hence folds.  Timelines that are too
long for an array go through :func:`long_min_gap`, which streams sorted rows with constant state.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def no_times() -> Column:
    return F.array().cast("array<double>")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` (or a lambda inside it) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def min_gap(times: Column, gap, strict: bool = True, seed: Column | None = None) -> Column:
    """Scans ascending times and keeps one iff it lies more than (not strict: at least) ``gap`` after the last kept one."""
    gap = gap if isinstance(gap, Column) else F.lit(float(gap))

    def step(kept: Column, t: Column) -> Column:
        d = t - F.element_at(kept, -1)
        return F.when((F.size(kept) == 0) | (d > gap if strict else d >= gap), F.array_append(kept, t)).otherwise(kept)

    return F.aggregate(times, no_times() if seed is None else seed, step)


def detected(times: Column, gap) -> Column:
    """Cuts of a detector pass: the strict gap rule, counted from a first stamp at 0."""
    return min_gap(times, gap, True, F.array(F.lit(0.0)))


def zero_start(times: Column) -> Column:
    """Puts 0 first if there is no time, or the first is above 0.1."""
    return let(times, lambda ts: F.when((F.size(ts) == 0) | (F.try_element_at(ts, F.lit(1)) > 0.1), F.concat(F.array(F.lit(0.0)), ts)).otherwise(ts))


def enforce_gap(times: Column, gap) -> Column:
    """Sorts, keeps times at least ``gap`` after the last kept one, and guarantees the zero start."""
    return zero_start(min_gap(F.array_sort(times), gap, strict=False))


def lower_bound(items: Column, field: str, value: Column) -> Column:
    """Place (from 0) of the first of sorted structs whose ``field`` is at least ``value``, or their number: a binary search, for arrays that many values are looked up in."""
    ends = F.struct(F.lit(0).alias("lo"), F.size(items).alias("hi"))

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        less = F.coalesce(F.get(items, mid)[field] < value, F.lit(True))  # structs without the field come first
        open_ = a["lo"] < a["hi"]
        return F.struct(F.when(open_ & less, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~less, mid).otherwise(a["hi"]).alias("hi"))

    halvings = F.sequence(F.lit(0), F.floor(F.log2(F.size(items) + 1)).cast("int"))
    return F.aggregate(halvings, ends, step, lambda a: a["lo"])


def far_from(times: Column, others: Column, distance) -> Column:
    """Times with no other within ``distance`` (a range anti join inside the row)."""
    distance = distance if isinstance(distance, Column) else F.lit(float(distance))
    return let(others, lambda os: F.filter(times, lambda t: ~F.exists(os, lambda o: F.abs(t - o) < distance)))


def adaptive_merge(primary: Column, sensitive: Column, gap) -> Column:
    """Primary cuts and those sensitive ones that are far from them, and from each other."""
    return let(primary, lambda ps: F.array_sort(F.concat(ps, min_gap(far_from(sensitive, ps, gap), gap, strict=False))))


def head_rescan(times: Column, extras: Column, gap, near: float = 0.3) -> Column:
    """Adds extra cuts not within ``near`` of a present one, then enforces the gap; an extra may displace a later cut."""
    return let(times, lambda ts: enforce_gap(F.concat(ts, far_from(extras, ts, near)), gap))


def range_anti_join(left: DataFrame, right: DataFrame, key: str, time: str, distance: float) -> DataFrame:
    """Rows of ``left`` with no row of ``right`` of the same key within ``distance``.

    Times are dealt into buckets as wide as the distance, and each right row into its own and both next ones, so this is
    an equi join even within one very long timeline.
    """
    width = F.lit(float(distance))
    a = left.withColumn("__bucket", F.floor(F.col(time) / width))
    b = right.select(F.col(key), F.col(time).alias("__time")).withColumn("__bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("__time") / width) + d)))
    on = (a[key] == b[key]) & (a["__bucket"] == b["__bucket"]) & (F.abs(a[time] - b["__time"]) < distance)
    return a.join(b, on, "left_anti").drop("__bucket")


def neighbours(points: DataFrame, marks: DataFrame, key: str, time: str) -> DataFrame:
    """Each point's previous mark (0 by default) and next mark (infinity by default): an as-of join both ways, by windows over a union."""
    both = points.select(key, time, F.lit(1).alias("__point")).unionByName(marks.select(key, time, F.lit(0).alias("__point")))
    mark = F.when(F.col("__point") == 0, F.col(time))
    w = Window.partitionBy(key)
    before = F.max(mark).over(w.orderBy(time, F.desc("__point")).rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(mark).over(w.orderBy(F.desc(time), F.desc("__point")).rowsBetween(Window.unboundedPreceding, -1))  # a frame that grows costs one step per row
    return both.withColumn("previous", F.coalesce(before, F.lit(0.0))).withColumn("next", F.coalesce(after, F.lit(float("inf")))).where("__point = 1").drop("__point")


def long_min_gap(rows: DataFrame, key: str, time: str, gap: float, strict: bool = True, zero: bool = True) -> DataFrame:
    """(key, time) of kept times, like :func:`min_gap`, for timelines of any length: rows come sorted and only the last kept time is held."""
    kind = rows.schema[key].dataType

    def run(batches):
        state: dict = {"key": None, "last": None}
        for b in batches:
            keys, times = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if state["last"] is None or k != state["key"]:
                    state["key"], state["last"] = k, 0.0 if zero else float("-inf")
                    if zero:
                        keys.append(k)
                        times.append(0.0)
                if t is not None and (t - state["last"] > gap if strict else t - state["last"] >= gap):
                    state["last"] = t
                    keys.append(k)
                    times.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(times, pa.float64())], [key, time])

    sorted_rows = rows.select(key, F.col(time).cast("double").alias(time)).repartition(key).sortWithinPartitions(key, time)
    return sorted_rows.mapInArrow(run, f"{key} {kind.simpleString()}, {time} double")
