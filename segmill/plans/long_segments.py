"""The whole smart plan for timelines of any length: the steps of ``segments.smart_segments``, each spread over time ranges.

Only the last step, the ordered merge/drop/new rule, takes a timeline as one stream; it gets a row per interval, not per frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.operators.boundaries import range_anti_join
from segmill.operators.dedup import long_merge_drop_new
from segmill.operators.frames import REACH
from segmill.operators.intervals import SHORTEST, scene_name
from segmill.operators.ranged import ranged_enforce_gap, ranged_first_frame, ranged_min_gap, ranged_neighbours
from segmill.params import Options
from segmill.shared import written


def _above(scores: DataFrame, threshold: float, key: str) -> DataFrame:
    """Times above a threshold; others are null, so that their timelines keep a row."""
    return scores.select(key, F.when(F.col("scene") > threshold, F.col("pts_time")).alias("t"))


def _far(left: DataFrame, right: DataFrame, key: str, distance: float) -> DataFrame:
    return range_anti_join(left, right, key, "t", distance)


def long_stamps(scores: DataFrame, o: Options, head: bool | None = None, key: str = "video_id") -> DataFrame:
    """(key, t): the boundaries of each timeline, as ``segments.stamps`` finds them."""
    cuts = written(ranged_min_gap(_above(scores, o.threshold, key), key, "t", o.gap), "cuts")
    if o.adaptive:
        sensitive = ranged_min_gap(_above(scores, o.adaptive_threshold, key), key, "t", o.adaptive_gap)
        extra = ranged_min_gap(_far(sensitive, cuts, key, o.gap), key, "t", o.gap, strict=False, zero=False)
        cuts = written(cuts.unionByName(extra), "cuts")
    if head if head is not None else not o.adaptive:
        heads = ranged_min_gap(_above(scores.where(F.col("pts_time") < o.head_seconds), o.head_threshold, key), key, "t", o.head_gap)
        cuts = written(ranged_enforce_gap(cuts.unionByName(_far(heads, cuts, key, 0.3)), key, "t", o.gap), "stamps")
    return cuts


def long_pieces(stamps: DataFrame, duration: Column, key: str = "video_id") -> DataFrame:
    """(key, t, dur): intervals from each boundary to the next, the last one to ``duration`` (a literal or a column of stamps), short ones left out."""
    ends = ranged_neighbours(stamps, stamps, key, "t").withColumn("end", F.when(F.col("next") < float("inf"), F.col("next")).otherwise(duration))
    return ends.select(key, "t", (F.col("end") - F.col("t")).alias("dur")).where(F.col("dur") >= SHORTEST)


def long_smart_segments(scores: DataFrame, duration: Column, o: Options, p: str = "p", c: str = "c", key: str = "video_id", head: bool | None = None) -> DataFrame:
    """key, seg, t, dur, parts, name, as ``segments.smart_segments``; times are seconds from 0 on, at most one boundary a time."""
    pieces = long_pieces(long_stamps(scores, o, head, key), duration, key).withColumnRenamed(key, "video_id")
    frames = scores.select(F.col(key).alias("video_id"), "pts_time", F.struct("scene", F.col(p).alias("p"), F.col(c).alias("c")).alias("frame"))
    cands = ranged_first_frame(pieces, frames, "frame", REACH).select(F.col("video_id").alias(key), "t", "dur", "frame.p", "frame.c")
    return long_merge_drop_new(cands, key).withColumn("name", scene_name(F.col("seg"), F.col("t")))
