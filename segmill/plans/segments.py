"""Whole plans: smart segments, fixed slices, model-scored cuts.  One shuffle by timeline, whatever the options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.operators import boundaries as B
from segmill.operators.dedup import merge_drop_new
from segmill.operators.frames import REACH
from segmill.operators.intervals import intervals, long_enough, scene_name
from segmill.params import Options


def marks(scores: DataFrame, *extra: str, key: str = "video_id") -> DataFrame:
    """One row per timeline with ``marks``, the sorted array of (pts_time, scene, extra...).

    Timelines without any cut keep their row, which filtering before grouping would lose.
    """
    return scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pts_time", "scene", *extra))).alias("marks"))


def times_above(items: Column, threshold: float) -> Column:
    return F.transform(F.filter(items, lambda m: m["scene"] > threshold), lambda m: m["pts_time"])


def content_cuts(items: Column, o: Options) -> Column:
    return B.detected(times_above(items, o.threshold), o.gap)


def adaptive_cuts(items: Column, o: Options) -> Column:
    sensitive = B.detected(times_above(items, o.adaptive_threshold), o.adaptive_gap)
    return B.adaptive_merge(content_cuts(items, o), sensitive, o.gap)


def head_cuts(items: Column, o: Options) -> Column:
    inside = F.filter(items, lambda m: m["pts_time"] < o.head_seconds)
    return B.detected(times_above(inside, o.head_threshold), o.head_gap)


def stamps(grouped: DataFrame, o: Options, head: bool | None = None) -> DataFrame:
    """``grouped`` with ``stamps``: the detector's cuts, and (content detector only, by default) those of the more sensitive head scan."""
    out = grouped.withColumn("stamps", adaptive_cuts(F.col("marks"), o) if o.adaptive else B.zero_start(content_cuts(F.col("marks"), o)))
    if head if head is not None else not o.adaptive:
        out = out.withColumn("_head", head_cuts(F.col("marks"), o)).withColumn("stamps", B.head_rescan(F.col("stamps"), F.col("_head"), o.gap)).drop("_head")
    return out


def smart_segments(scores: DataFrame, duration: Column, o: Options, p: str = "p", c: str = "c", key: str = "video_id", head: bool | None = None) -> DataFrame:
    """key, seg, t, dur, parts, name: cuts, intervals, then the merge/drop/new rule on each interval's first frame.

    ``scores``: key, pts_time, scene, and the frame's two hashes.  An interval's frame is the first within REACH seconds from its start;
    an interval without one is skipped.
    """
    grouped = stamps(marks(scores, p, c, key=key), o, head)
    pieces = grouped.withColumn("pieces", long_enough(intervals(F.col("stamps"), duration)))

    found = F.transform("pieces", lambda x: F.struct(x["t"].alias("t"), x["dur"].alias("dur"), F.get("marks", B.lower_bound(F.col("marks"), "pts_time", x["t"])).alias("f")))

    def near(x: Column, name: str) -> Column:
        return F.when(x["f"]["pts_time"] < x["t"] + REACH, x["f"][name]).alias("p" if name == p else "c")

    cands = F.transform(found, lambda x: F.struct(x["t"].alias("t"), x["dur"].alias("dur"), near(x, p), near(x, c)))
    out = pieces.select(key, F.posexplode(merge_drop_new(cands)).alias("seg", "s"))
    return out.select(key, F.col("seg").cast("long").alias("seg"), "s.t", "s.dur", "s.parts", scene_name(F.col("seg"), F.col("s.t")).alias("name"))
