"""Writers: task tables, metrics, settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_tasks(tasks: DataFrame, path: str, threads: int = 3) -> dict:
    """Writes segments partitioned by video with at most ``threads`` writers (the stage before keeps its own tasks), and returns run metrics of the same pass."""
    seen = Observation("tasks")
    watched = tasks.observe(seen, F.count(F.lit(1)).alias("tasks"), F.coalesce(F.sum("dur"), F.lit(0.0)).alias("seconds"))
    watched.repartition(max(1, threads), "video_id").write.mode("overwrite").partitionBy("video_id").parquet(path)
    return seen.get


def write_preference(df: DataFrame, path: str) -> None:
    """The language setting as a text file: auto, zh or en."""
    df.select(F.when(F.col("preference").isin("zh", "en"), F.col("preference")).otherwise("auto").alias("value")).coalesce(1).write.mode("overwrite").text(path)
