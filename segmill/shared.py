"""Tables in the folder that the driver and all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


@functools.lru_cache(1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="segmill-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, one of the driver's own, which only ``local[*]`` masters may use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once and read back.  They outlive any executor, and go when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _WRITTEN:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass
