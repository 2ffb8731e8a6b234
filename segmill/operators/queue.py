"""The work queue as tables: intake, removal, membership, order, capacity, encoder choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions.text import extension, file_name, is_video


def intake(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """path, name, ext of the accepted files, repeats kept; ``pos``, if the table has it, stays and tells the order (:func:`in_order`)."""
    p = F.col(path_col)
    keep = [F.col("pos")] if "pos" in paths.columns else []
    return paths.where(is_video(p)).select(*keep, p.alias("path"), file_name(p).alias("name"), extension(p).alias("ext"))


def in_order(queue: DataFrame, first: int | None = None) -> DataFrame:
    """The queue as it is worked off: by ``pos``, or by batch, time and path as :func:`segmill.streaming.queue.take_files` leaves it; only the ``first`` ones if asked, which is no sort of the whole."""
    by = ["pos", "path"] if "pos" in queue.columns else ["batch", "modificationTime", "path"]
    ordered = queue.orderBy(*by)
    return ordered if first is None else ordered.limit(first)


def remove(queue: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return queue.join(gone.select(key).distinct(), key, "left_anti")


def still_queued(rows: DataFrame, queue: DataFrame, key: str) -> DataFrame:
    return rows.join(queue.select(key), key, "left_semi")


def newest(files: DataFrame, suffix: str = ".mp4") -> DataFrame:
    """The most recently changed file with a suffix, or no row: a top-1, not a sort."""
    return files.where(F.lower("path").endswith(suffix)).orderBy(F.desc("modificationTime"), "path").limit(1)


def first_existing(candidates: DataFrame, existing: DataFrame, default: str) -> DataFrame:
    """path of the first of candidates(level, candidate, path) that exists, else the default."""
    hit = candidates.join(existing.select("path").distinct(), "path", "left_semi")
    return hit.agg(F.coalesce(F.min_by("path", F.struct("level", "candidate")), F.lit(default)).alias("path"))


def last_existing_line(lines: DataFrame, existing: DataFrame) -> DataFrame:
    """The last of lines(line_no, line) that names an existing path."""
    hit = lines.join(existing.select(F.col("path").alias("line")).distinct(), "line", "left_semi")
    return hit.agg(F.max_by("line", "line_no").alias("path"))


def capacity(cores: Column, memory_gb: Column, hardware: Column) -> Column:
    """Suggested number of parallel exports; memory 0 or null is unknown."""
    known = F.coalesce(memory_gb, F.lit(0))
    cap = F.when(known <= 0, 4).when(known < 8, 1).when(known < 12, 2).when(known < 16, 3).when(known < 32, 6).otherwise(16)
    n = F.least(F.greatest(F.lit(1), F.floor(cores / 2)), cap)
    gpu = F.least(n, F.when(known >= 32, 5).otherwise(3))
    cpu = F.when((known > 0) & (known < 16) & (n > 4), 4).otherwise(n)  # never binds: the cap is lower there
    return F.greatest(F.lit(1), F.when(hardware, gpu).otherwise(cpu)).cast("long")


def encoder_choice(works: DataFrame, fallback: str = "libx264") -> DataFrame:
    """The working encoder of the highest priority from works(encoder, priority, works), else the fallback."""
    return works.where("works").agg(F.coalesce(F.min_by("encoder", "priority"), F.lit(fallback)).alias("encoder"))
