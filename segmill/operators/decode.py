"""From model scores per frame to cut times; model windows and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boundaries import min_gap

WINDOW_FRAMES = 100
BATCH = 24
FIRST_CUT, CUT_GAP = 0.05, 0.25  # seconds


def score_islands(scores: DataFrame, threshold: float, key: str = "video_id", order: str = "frame_no", score: str = "score") -> DataFrame:
    """key, first, last, centre of each run of consecutive frames whose score reaches the threshold."""
    above = scores.where(F.col(score) >= threshold)
    island = F.col(order) - F.row_number().over(Window.partitionBy(key).orderBy(order))
    runs = above.withColumn("_island", island).groupBy(key, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    return runs.select(key, "first", "last", F.expr("(first + last) div 2").alias("centre"))


def spaced_cuts(centres: Column, fps: float) -> Column:
    """Seconds of sorted centres: above FIRST_CUT, and more than CUT_GAP after the last kept."""
    times = F.filter(F.transform(centres, lambda c: c / F.lit(float(fps))), lambda t: t > FIRST_CUT)
    return min_gap(times, CUT_GAP)


def decode_cuts(scores: DataFrame, threshold: float, fps: float, key: str = "video_id", order: str = "frame_no", score: str = "score") -> DataFrame:
    """key, t of the cuts that per-frame scores tell of."""
    islands = score_islands(scores, threshold, key, order, score)
    cuts = islands.groupBy(key).agg(spaced_cuts(F.array_sort(F.collect_list("centre")), fps).alias("_cuts"))
    return cuts.select(key, F.explode("_cuts").alias("t"))


def batch_number(idx: Column, size: int = BATCH) -> Column:
    return F.floor(idx / size)


def model_windows(frames: DataFrame, key: str = "video_id", order: str = "frame_no", size: int = WINDOW_FRAMES) -> DataFrame:
    """key, window, slot, source frame: windows of ``size`` frames without overlap, the last one filled up with the last frame."""
    n = frames.groupBy(key).agg((F.max(order) + 1).alias("_n"))
    windows = n.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / size) - 1)))
    slots = windows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return slots.select(key, "window", "slot", F.least(F.col("_n") - 1, F.col("window") * size + F.col("slot")).alias(order))
