"""Frames for times: as-of lookups with fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 0.2  # seconds after a wanted time in which its frame may come


def first_frame_after(wanted: DataFrame, frames: DataFrame, value: str, reach: float = REACH) -> DataFrame:
    """wanted(video_id, idx, t) with the ``value`` of its video's first frame in [max(0, t), max(0, t) + reach), or null.

    Frames are dealt into buckets of ``reach`` seconds and each wanted time asks its own bucket and the next: an equi
    join on video and bucket; the first frame is kept by an aggregation, so no video has to fit in one task.  Rows with one idx
    but different times are looked up apart.  Of frames at one time the least value is taken.  Where one bucket may hold many frames, ``ranged.ranged_first_frame`` does not pair them.
    """
    start = F.greatest(F.lit(0.0), F.col("t"))
    ask = wanted.withColumn("__b", F.explode(F.array(F.floor(start / reach), F.floor(start / reach) + 1)))
    give = frames.select(F.col("video_id"), F.col("pts_time").alias("__pts"), F.col(value).alias("__value"), F.floor(F.col("pts_time") / reach).alias("__b"))
    hit = (F.col("__pts") >= start) & (F.col("__pts") < start + reach)
    found = ask.join(give, ["video_id", "__b"]).where(hit).groupBy("video_id", "idx", start.alias("__start")).agg(F.min(F.struct("__pts", "__value"))["__value"].alias(value))
    return wanted.withColumn("__start", start).join(found, ["video_id", "idx", "__start"], "left").drop("__start")


def with_fallback(wanted: DataFrame, batch: DataFrame, single: DataFrame, value: str) -> DataFrame:
    """Value from the batch lookup, else from the single one, else null; both keyed (video_id, idx), and by the time ``t`` where they have it.

    Every row of ``wanted`` gives one row, also where rows are repeated or one idx has several times.
    """
    out = wanted
    for found, name in ((batch, "_first"), (single, "_second")):
        keys = ["video_id", "idx", *(["__start"] if "t" in wanted.columns and "t" in found.columns else [])]
        start = F.greatest(F.lit(0.0), F.col("t"))  # as first_frame_after has it: never null
        if "__start" in keys:
            out, found = out.withColumn("__start", start), found.withColumn("__start", start)
        out = out.join(found.groupBy(keys).agg(F.min(value).alias(name)), keys, "left").drop("__start")
    return out.withColumn(value, F.coalesce("_first", "_second")).drop("_first", "_second")


def thumbnails(videos: DataFrame, frames: DataFrame, value: str, at: tuple[float, ...] = (1.0, 0.1)) -> DataFrame:
    """Each video's frame at the first of some times that has one."""
    wanted = videos.select("video_id", F.posexplode(F.array(*(F.lit(t) for t in at))).alias("idx", "t"))
    found = first_frame_after(wanted, frames, value).where(F.col(value).isNotNull())
    best = found.groupBy("video_id").agg(F.min_by(value, "idx").alias(value))
    return videos.join(best, "video_id", "left")
