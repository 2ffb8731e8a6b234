"""From boundaries to intervals: segments, fixed slices, names, commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions.text import directory, stem

from .boundaries import let

SHORTEST = 0.5  # seconds; shorter intervals are dropped


def intervals(times: Column, end: Column) -> Column:
    """(t, dur) of each time to the next one, the last to ``end``."""
    def pieces(ts: Column) -> Column:
        return F.transform(ts, lambda t, i: F.struct(t.alias("t"), (F.when(i + 1 < F.size(ts), F.get(ts, i + 1)).otherwise(end) - t).alias("dur")))

    return let(times, pieces)


def long_enough(pieces: Column, shortest: float = SHORTEST) -> Column:
    return F.filter(pieces, lambda p: p["dur"] >= shortest)


def fixed_slices(videos: DataFrame, seconds: float, id_col: str = "video_id", duration_col: str = "duration") -> DataFrame:
    """id, seg, t, dur: slices of ``seconds``, the last one shorter, none below half a second.  Narrow: no shuffle.

    Starts are multiples (not repeated sums), which differs from summing only where the tail is exactly half a second.
    A duration that is not positive is an error.
    """
    d = F.when(F.col(duration_col) > 0, F.col(duration_col)).otherwise(F.raise_error(F.lit("duration must be positive")).cast("double"))
    rows = videos.select(id_col, d.alias("_d")).withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_d") / seconds) - 1)))
    rows = rows.withColumn("t", F.col("seg") * F.lit(float(seconds)))
    return rows.select(id_col, "seg", "t", F.least(F.lit(float(seconds)), F.col("_d") - F.col("t")).alias("dur")).where(f"dur >= {SHORTEST}")


def scene_name(seg: Column, t: Column) -> Column:
    return F.format_string("Scene_%03d_%.2fs.mp4", seg, t)


def output_dir(path: Column) -> Column:
    """A folder beside the source, named after it; for a bare name, in the working folder."""
    folder = directory(path)
    return F.concat(folder, F.when((folder == "") | folder.rlike(r"[/\\]$"), "").otherwise("/"), stem(path), F.lit("_Scenes"))


def cut_command(path: Column, out: Column, t: Column, dur: Column, mute: bool, encoder: Column, hardware: Column) -> Column:
    """The argument string of the external cutter; running it is not this library's business."""
    return F.concat_ws(
        " ",
        F.lit("-y"),
        F.when(hardware, F.lit("-hwaccel auto")),
        F.format_string("-ss %.3f -t %.3f", t, dur),
        F.concat(F.lit('-i "'), path, F.lit('"')),
        F.concat(F.lit("-c:v "), encoder),
        F.lit("-an" if mute else "-c:a aac"),
        F.concat(F.lit('"'), out, F.lit('"')),
    )


def filter_rate(tasks: Column, stamps: Column) -> Column:
    """Share of stamps that gave no task, in percent."""
    return (1 - tasks / F.greatest(F.lit(1), stamps)) * 100
