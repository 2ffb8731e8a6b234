"""The ordered rules for timelines that are too long for one task.

A timeline is cut into time ranges that different tasks work on.  What a range needs from those before it is small: the last kept time,
the nearest mark, whether a run is still open.  It is computed per range first, carried over the ranges of a timeline, and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.shared import written

ROWS_PER_RANGE = 1_000_000  # times that a task holds at once; a longer stretch of a timeline becomes several ranges


def _parallel(df: DataFrame) -> int:
    """Ranges for a session: its shuffle partitions, and no fewer than its cores."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


# ---- minimum gap ------------------------------------------------------------------------------------------------


def _following(t: np.ndarray, gap: float, strict: bool) -> np.ndarray:
    """For each of ascending times the position of the next one that the rule keeps after it, or ``len(t)``."""
    n, places = len(t), np.arange(len(t))

    def far(j: np.ndarray) -> np.ndarray:
        d = t[j] - t
        return d > gap if strict else d >= gap

    nxt = np.searchsorted(t, t + gap, "right" if strict else "left")
    while (late := (nxt < n) & ~far(np.minimum(nxt, n - 1))).any():  # t + gap is rounded, the rule's difference is rounded otherwise
        nxt[late] += 1
    while (early := (nxt - 1 > places) & far(nxt - 1)).any():
        nxt[early] -= 1
    return nxt


def entry_table(t: np.ndarray, gap: float, strict: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a range of ascending distinct times keeps, for any last kept time L before it: (time, after, until, last).

    A time is kept iff the first time that is far enough from L comes later than ``after`` (NaN: whatever comes first) and no later than
    ``until``; ``last`` marks those after which the range keeps none.  The first kept time is one of those up to the one that follows
    the range's first time, and the times kept from there on are a chain.  Chains keep their order and mostly meet soon; each place
    of a chain is told once, with the first and last of the chains through it.
    """
    n, nxt = len(t), _following(t, gap, strict)
    e = int(nxt[0])  # where the chain from place 0 goes on: entering there is the same chain without place 0
    at, low, high = [], [], []

    def tell(places, first, final) -> None:
        at.append(np.atleast_1d(places))
        low.append(np.broadcast_to(first, at[-1].shape))
        high.append(np.broadcast_to(final, at[-1].shape))

    now = first = final = np.arange(e)
    level = 0
    while len(now) > 1:
        tell(now, first, final)
        if level and e < n and first[0] == 0:
            tell(now[:1], e, e)
        alive = nxt[now] < n
        ahead, first, final = nxt[now][alive], first[alive], final[alive]
        starts = np.flatnonzero(np.append(True, ahead[1:] != ahead[:-1])[: len(ahead)])
        now, first, final = ahead[starts], first[starts], final[np.append(starts[1:], len(ahead)) - 1] if len(ahead) else final
        level += 1
    if len(now):  # one chain is left
        chain, place, follow = [], int(now[0]), nxt.tolist()
        while place < n:
            chain.append(place)
            place = follow[place]
        chain = np.array(chain)
        if level == 0:
            tell(chain[:1], 0, 0)
            chain = chain[1:]
        whole = int(final[0]) == e - 1 and e < n
        tell(chain, 0, e if whole else int(final[0]))
        if not whole and e < n:
            tell(chain, e, e)
    at, low, high = np.concatenate(at), np.concatenate(low), np.concatenate(high)
    return t[at], np.where(low > 0, t[low - 1], np.nan), t[high], nxt[at] == n


def _timelines(batches, limit: int) -> Iterator[tuple[pa.Scalar, np.ndarray, bool]]:
    """Stretches of one timeline's ascending distinct times, of about ``limit`` times at most, from sorted (key, time) batches."""
    key, held, size = None, [], 0
    for b in batches:
        runs = pc.run_end_encode(b.column(0))
        start = 0
        for value, end in zip(runs.values, runs.run_ends.to_pylist(), strict=True):
            if held and (size >= limit or not value.equals(key)):
                yield key, np.unique(np.concatenate(held))
                held, size = [], 0
            key = value
            held.append(np.unique(b.column(1).slice(start, end - start).to_numpy(zero_copy_only=False)))
            size += len(held[-1])
            start = end
    if held:
        yield key, np.unique(np.concatenate(held))


def ranged_min_gap(rows: DataFrame, key: str, time: str, gap: float, strict: bool = True, zero: bool = True, ranges: int | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(key, time) of kept times, like ``long_min_gap``, with all cores at work inside one timeline.

    Rows are dealt out by ranges of (key, time) and sorted; each task turns its ranges into their entry tables (:func:`entry_table`), which hold a
    few times per kept one unless a gap is as wide as a range.  A scan over the ranges of each timeline, which reads only how a range may
    end, finds the time that each range is entered with, and a join on the range keeps what follows from it.  Equal times may fall into
    different ranges, so that many of them are no hot task.

    ``gap`` must be positive.  Null and non-finite times are no times (a timeline keeps its zero), null keys are a timeline; repeated times count once, empty tables
    give nothing, and other columns are left out.  With ``zero`` each timeline keeps 0 first, and no time up to 0.
    """
    if not gap > 0:
        raise ValueError("the gap must be positive")
    kind = rows.schema[key].dataType
    t = F.col(time).cast("double")
    usable = rows.where(F.abs(t) < float("inf"))
    if zero:
        usable = usable.where(t > 0)
    dealt = usable.select(F.col(key).alias("key"), t.alias("t"), F.spark_partition_id().alias("origin")).repartitionByRange(ranges or _parallel(rows), "key", "t", "origin")
    ordered = dealt.sortWithinPartitions("key", "t").select("key", "t", F.spark_partition_id().cast("long").alias("part"))

    def tables(batches):
        part = 0

        def watched():
            nonlocal part
            for b in batches:
                if b.num_rows:
                    part = b.column(2)[0].as_py()
                    yield b

        for i, (k, times) in enumerate(_timelines(watched(), rows_per_range)):
            kept, after, until, last = entry_table(times, gap, strict)
            columns = [pa.repeat(k, len(kept)), pa.array(np.full(len(kept), (part << 32) + i)), pa.array(kept), pa.array(after, from_pandas=True), pa.array(until), pa.array(last)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "range", "t", "after", "until", "last"])

    told = written(ordered.mapInArrow(tables, f"key {kind.simpleString()}, range long, t double, after double, until double, last boolean"), "gap-tables")

    def scan(batches):
        key, range_, entry, done = None, None, None, False
        for b in batches:
            out = []
            for k, r, at, until in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if key is None or not k.equals(key):
                    key, range_, entry = k, None, 0.0 if zero else float("-inf")
                if r != range_:
                    range_, done = r, False
                    out.append((k.as_py(), r, entry))
                if not done and (until - entry > gap if strict else until - entry >= gap):
                    entry, done = at, True
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], b.schema.field(0).type if i == 0 else s) for i, s in enumerate((None, pa.int64(), pa.float64()))], ["to", "at", "entry"])

    ends = told.where("last").select("key", "range", "t", "until").repartition("key").sortWithinPartitions("key", "range", "until")
    entries = ends.mapInArrow(scan, f"to {kind.simpleString()}, at long, entry double")

    def far(c: str) -> Column:
        d = F.col(c) - F.col("entry")
        return d > gap if strict else d >= gap

    met = told.join(entries, told["key"].eqNullSafe(entries["to"]) & (told["range"] == entries["at"]))
    kept = met.where((F.col("after").isNull() | ~far("after")) & far("until")).select(F.col("key").alias(key), F.col("t").alias(time))
    return kept.unionByName(rows.select(key).distinct().withColumn(time, F.lit(0.0))) if zero else kept


def ranged_enforce_gap(rows: DataFrame, key: str, time: str, gap: float, **how) -> DataFrame:
    """(key, time): times at least ``gap`` after the last kept one, and a 0 for timelines that have none or begin above 0.1."""
    kept = ranged_min_gap(rows, key, time, gap, strict=False, zero=False, **how)
    first = kept.select(F.col(key).alias("__key"), F.col(time).alias("__t")).groupBy("__key").agg(F.min("__t").alias("__first"))
    keys = rows.select(key).distinct()
    late = keys.join(first, keys[key].eqNullSafe(first["__key"]), "left").where("__first is null or __first > 0.1")
    return kept.unionByName(late.select(key, F.lit(0.0).alias(time)))


# ---- neighbours -------------------------------------------------------------------------------------------------


def time_ranges(df: DataFrame, time: str, like: DataFrame | None = None, ranges: int | None = None) -> Bucketizer:
    """Puts about equally many rows of ``df`` (or ``like``) into each range; the driver gets the ranges' borders only."""
    n = ranges or _parallel(df)
    times = (df if like is None else like).select(F.col(time).cast("double").alias(time)).where(F.abs(F.col(time)) < float("inf"))
    borders = sorted(set(times.approxQuantile(time, [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    return Bucketizer(splits=[float("-inf"), *(borders or [0.0]), float("inf")], inputCol="__time", outputCol="__range", handleInvalid="keep")


def _carried(both: DataFrame, key: str, before: Column, after: Column) -> DataFrame:
    """Per (key, range): the greatest ``before`` of all earlier ranges and the least ``after`` of all later ones.  A timeline has a row per range here."""
    each = both.groupBy(key, "__range").agg(F.max(before).alias("__max"), F.min(after).alias("__min"))
    w = Window.partitionBy(key)
    earlier = F.max("__max").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    later = F.min("__min").over(w.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1))
    return each.select(F.col(key).alias("__k"), F.col("__range").alias("__r"), earlier.alias("__earlier"), later.alias("__later"))


def ranged_neighbours(points: DataFrame, marks: DataFrame, key: str, time: str, ranges: int | None = None) -> DataFrame:
    """Each point's previous mark (0 by default) and next mark (infinity by default), as ``boundaries.neighbours``, for timelines of any length.

    Windows run within (timeline, time range) only; the nearest marks outside a range are carried over the ranges and joined back.  Points and
    marks without a time meet nothing; repeated points give a row each.
    """
    both = points.select(key, time, F.lit(1).alias("__point")).unionByName(marks.select(key, time, F.lit(0).alias("__point")))
    both = time_ranges(both, time, ranges=ranges).transform(both.withColumn("__time", F.col(time).cast("double"))).drop("__time")
    mark = F.when(F.col("__point") == 0, F.col(time))
    w = Window.partitionBy(key, "__range")
    before = F.max(mark).over(w.orderBy(time, F.desc("__point")).rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(mark).over(w.orderBy(F.desc(time), F.desc("__point")).rowsBetween(Window.unboundedPreceding, -1))
    inside = both.withColumn("__before", before).withColumn("__after", after).where("__point = 1")
    carried = _carried(both, key, mark, mark)  # of points too, so that ranges without marks have a row
    out = inside.join(carried, inside[key].eqNullSafe(carried["__k"]) & (inside["__range"] == carried["__r"]), "left")
    known = F.col(time).isNotNull()
    return out.select(key, time, F.when(known, F.coalesce("__before", "__earlier", F.lit(0.0))).alias("previous"), F.when(known, F.coalesce("__after", "__later", F.lit(float("inf")))).alias("next"))


def ranged_first_frame(wanted: DataFrame, frames: DataFrame, value: str, reach: float, ranges: int | None = None) -> DataFrame:
    """wanted(video_id, t, ...) with the ``value`` of its video's first frame in [max(0, t), max(0, t) + reach), or null.

    Unlike ``frames.first_frame_after`` no wanted time is paired with each frame of its bucket: every wanted row looks up the next frame by windows within
    (video, time range), so many frames within one reach cost nothing extra.  Of frames at one time the least value is taken; rows are told apart by all their columns.
    """
    columns = wanted.columns
    row = F.struct(*[F.col(c) for c in columns])
    ask = wanted.select(F.col("video_id").alias("__key"), F.greatest(F.lit(0.0), F.col("t").cast("double")).alias("__time"), F.lit(1).alias("__wanted"), row.alias("__row"), F.lit(None).cast(frames.schema[value].dataType).alias("__value"))
    give = frames.select(F.col("video_id").alias("__key"), F.col("pts_time").cast("double").alias("__time"), F.lit(0).alias("__wanted"), F.lit(None).cast(ask.schema["__row"].dataType).alias("__row"), F.col(value).alias("__value"))
    both = ask.unionByName(give.where("__time is not null"))
    both = time_ranges(both, "__time", ranges=ranges).transform(both)
    frame = F.when(F.col("__wanted") == 0, F.struct("__time", "__value"))
    here = F.min(frame).over(Window.partitionBy("__key", "__range").orderBy(F.desc("__time"), "__wanted").rowsBetween(Window.unboundedPreceding, 0))
    inside = both.withColumn("__here", here).where("__wanted = 1")
    carried = _carried(both, "__key", frame, frame)
    out = inside.join(carried, inside["__key"].eqNullSafe(carried["__k"]) & (inside["__range"] == carried["__r"]), "left")
    found = F.coalesce("__here", "__later")
    return out.select("__row.*", F.when(found["__time"] < F.col("__time") + reach, found["__value"]).alias(value))


# ---- islands ----------------------------------------------------------------------------------------------------


def ranged_islands(scores: DataFrame, threshold: float, key: str = "video_id", order: str = "frame_no", score: str = "score", frames_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """key, first, last, centre of each run of consecutive frames whose score reaches the threshold, for timelines of any length.

    Runs are found within ranges of frame numbers; only those that touch a border of their range, two per range at most, are put together over
    the ranges of a timeline.  A frame that comes twice counts once.
    """
    above = scores.where(F.col(score) >= threshold).select(F.col(key), F.col(order).cast("long").alias("__n"))
    above = above.withColumn("__range", F.floor(F.col("__n") / frames_per_range))
    island = F.col("__n") - F.dense_rank().over(Window.partitionBy(key, "__range").orderBy("__n"))
    runs = above.withColumn("__island", island).groupBy(key, "__range", "__island").agg(F.min("__n").alias("first"), F.max("__n").alias("last"))
    begins, ends = F.col("__range") * frames_per_range, (F.col("__range") + 1) * frames_per_range - 1
    touching = (F.col("first") == begins) | (F.col("last") == ends)
    inner = runs.where(~touching).select(key, "first", "last")
    w = Window.partitionBy(key).orderBy("first")
    opened = F.when(F.col("first") == F.lag("last").over(w) + 1, 0).otherwise(1)
    outer = runs.where(touching).withColumn("__new", opened).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = outer.groupBy(key, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__run")
    return inner.unionByName(joined).select(key, "first", "last", F.expr("(first + last) div 2").alias("centre"))


def ranged_cuts(scores: DataFrame, threshold: float, fps: float, key: str = "video_id", order: str = "frame_no", score: str = "score", **how) -> DataFrame:
    """key, t of the cuts that per-frame scores tell of, as ``decode.decode_cuts``, for timelines of any length."""
    from .decode import CUT_GAP, FIRST_CUT

    centres = ranged_islands(scores, threshold, key, order, score).select(key, (F.col("centre") / F.lit(float(fps))).alias("t")).where(F.col("t") > FIRST_CUT)
    return ranged_min_gap(centres, key, "t", CUT_GAP, strict=True, zero=False, **how)
