"""The running queue: files that appear in a folder are taken once each, in order, across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segmill.operators.queue import intake

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
TABLE = "path string, name string, ext string, modificationTime timestamp, length long, batch long"


def batch_writer(table: str) -> Callable[[DataFrame, int], None]:
    """Writes the accepted files of a micro-batch as the part of the table that has its number.

    A batch that is repeated after a failure replaces its own part, so no file is in the table twice.
    """

    def write(files: DataFrame, batch: int) -> None:
        named = intake(files)
        times = files.select("path", "modificationTime", "length").distinct()
        named.distinct().join(times, "path").write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={batch}")

    return write


def take_files(spark: SparkSession, folder: str, table: str, checkpoint: str, files_per_batch: int = 1000, once: bool = True) -> StreamingQuery:
    """Starts taking the video files of ``folder`` (older ones first) into ``table``; file contents are not read.

    The checkpoint knows which files were taken.  A query that is started again with the same checkpoint and table goes on with the next batch number;
    one checkpoint belongs to one table.  With ``once`` the query ends when all present files are taken.
    """
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "modificationTime", "length")
    writer = stream.writeStream.foreachBatch(batch_writer(table)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def queue_table(spark: SparkSession, table: str) -> DataFrame:
    """path, name, ext, modificationTime, length, batch of the files taken so far; ``operators.queue.in_order`` gives their order."""
    return spark.read.schema(TABLE).option("basePath", table).parquet(f"{table.rstrip('/')}/batch=*").withColumn("batch", F.col("batch").cast("long"))
