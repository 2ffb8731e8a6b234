"""Tumbling windows over streams and tables.  Ordered rules over streams are in :mod:`segmill.streaming.ordered`."""

from __future__ import annotations

from pyspark.sql import DataFrame


def tumbling_counts(rows: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window of time and type, with late data up to ``late``; works on streams and tables."""
    from pyspark.sql import functions as F

    stamped = rows.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        stamped = stamped.withWatermark(time, late)
    out = stamped.groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")
