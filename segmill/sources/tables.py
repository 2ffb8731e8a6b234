"""Readers: score tables, score logs, frame streams, file lists, settings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def score_scan(frames: DataFrame, threshold: float, start: float = 0.0, seconds: float | None = None) -> DataFrame:
    """Rows whose score exceeds the threshold (rounded to 3 decimals) in a time range; both conditions reach the Parquet scan if both are stored columns."""
    out = frames.where((F.col("scene") > round(threshold, 3)) & (F.col("pts_time") >= start))
    return out if seconds is None else out.where(F.col("pts_time") < start + seconds)


def score_log(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """pts_time of the detector's log lines; other columns are kept."""
    hit = F.col(line_col).contains("showinfo") & F.col(line_col).rlike(r"pts_time:[0-9.]+")
    return lines.where(hit).withColumn("pts_time", F.regexp_extract(line_col, r"pts_time:([0-9.]+)", 1).try_cast("double")).where("pts_time is not null")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length; the contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Picture files as frames for ``functions.images.fingerprints``: video_id (the file), idx 0, height, width, mode, data, error.

    Spark's reader gives pixels in the order blue, green, red (, alpha) and names their kind by a number; grey, three and four channels of 8 bits are
    kinds known here.  A file that is no picture, or one of another kind, has a null picture and says so in ``error``.
    """
    rows = spark.read.format("image").load(folder).select("image.*")
    mode = F.element_at(F.create_map(*[F.lit(x) for kind in ((0, "gray8"), (16, "bgr24"), (24, "bgra")) for x in kind]), F.col("mode"))
    error = F.when(F.col("height") <= 0, "no picture").when(mode.isNull(), F.concat(F.lit("kind "), F.col("mode").cast("string")))
    return rows.select(
        F.col("origin").alias("video_id"), F.lit(0).cast("long").alias("idx"), F.when(error.isNull(), F.col("height")).alias("height"), F.when(error.isNull(), F.col("width")).alias("width"),
        mode.alias("mode"), F.when(error.isNull(), F.col("data")).alias("data"), error.alias("error"),
    )


def preference(text: Column) -> Column:
    """A settings file's language, white space and line ends around it gone; ``auto`` for anything else."""
    t = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(t.isin("zh", "en"), t).otherwise("auto")


def read_exact(stream, n: int) -> bytes:
    """``n`` bytes, or fewer at the end of the stream."""
    parts, left = [], n
    while left:
        part = stream.read(left)
        if not part:
            break
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


def split_frames(stream, frame_bytes: int) -> Iterator[bytes]:
    """Whole frames of a raw stream; a broken last frame is dropped."""
    while len(frame := read_exact(stream, frame_bytes)) == frame_bytes:
        yield frame


def raw_frames(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """video_id (the path), frame_no, rgb of short raw rgb24 files in any store that Spark can read.

    Each file is one value here, of 2 GB at most; ``frames.frame_table`` reads long videos by ranges.
    """
    import pyarrow as pa

    size = width * height * 3

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for at in range(0, len(data) // size, 256):
                    rows = [data[k * size : (k + 1) * size] for k in range(at, min(at + 256, len(data) // size))]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.binary())], ["video_id", "frame_no", "rgb"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "video_id string, frame_no long, rgb binary")
