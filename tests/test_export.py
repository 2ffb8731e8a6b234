"""Export: a failed segment is a row, counts come from the commit, a failed job leaves nothing."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from segmill.sources.export import SegmentExport, export_progress, export_results, export_segments


class Loud(SegmentExport):
    """Fails on segment 57."""

    @classmethod
    def name(cls):
        return "loud"

    def data_of(self, row):
        if row["seg"] == 57:
            raise RuntimeError("no such frame")
        return f"{row['video_id']}:{row['seg']}".encode()


class Noting(SegmentExport):
    """Looks at the progress of the tasks at work."""

    @classmethod
    def name(cls):
        return "noting"

    def data_of(self, row):
        return str(export_progress(self.options["path"])["done"]).encode()


def segments(spark, n=100):
    return spark.range(n).select(F.lit("v").alias("video_id"), F.col("id").alias("seg"), F.lit(1.5).alias("dur"), F.concat(F.lit("v_Scenes_"), (F.col("id") % 3).cast("string")).alias("folder"), F.format_string("Scene_%03d.mp4", "id").alias("name"))


def exported(path):
    return sorted(f for root, _, files in os.walk(path) for f in files if f.startswith("Scene"))  # staged ones too


def test_one_failure_of_a_hundred(spark, tmp_path):
    path = str(tmp_path / "out")
    assert export_segments(segments(spark), path, 4, Loud) == {"tasks": 100, "done": 99, "failed": 1, "seconds": 148.5}
    assert len(exported(path)) == 99 and open(f"{path}/v_Scenes_1/Scene_058.mp4").read() == "v:58"
    rows = export_results(spark, path)
    assert [tuple(r) for r in rows.where("error is not null").collect()] == [("v_Scenes_0", "Scene_057.mp4", 1.5, None, "RuntimeError: no such frame")]
    assert rows.where("error is null").agg(F.count("*"), F.sum("bytes")).first()[:] == (99, sum(len(f"v:{i}") for i in range(100) if i != 57))
    assert export_progress(path) == {"done": 0, "failed": 0} and not [f for _, _, fs in os.walk(path) for f in fs if f.startswith(".") and not f.endswith(".crc")]


def test_data_column_and_odd_rows(spark, tmp_path):
    rows = [("a", "1.mp4", 1.0, b"x"), ("a", "2.mp4", 1.0, None), ("a", None, 1.0, b"y"), (None, "3.mp4", 1.0, b"y"), ("a/../../b", "4.mp4", 1.0, b"y"), ("a", "../5.mp4", 1.0, b"y"), ("/deep/er", "6.mp4", None, b"zz")]
    told = export_segments(spark.createDataFrame(rows, "folder string, name string, dur double, data binary"), str(tmp_path / "o"), 2)
    assert told == {"tasks": 7, "done": 2, "failed": 5, "seconds": 1.0}
    assert open(tmp_path / "o/a/1.mp4", "rb").read() == b"x" and open(tmp_path / "o/deep/er/6.mp4", "rb").read() == b"zz"
    assert export_results(spark, str(tmp_path / "o")).where("error is not null").count() == 5
    empty = export_segments(spark.createDataFrame([], "folder string, name string, dur double, data binary"), str(tmp_path / "e"))
    assert empty == {"tasks": 0, "done": 0, "failed": 0, "seconds": 0}


def test_progress_while_at_work(spark, tmp_path):
    path = str(tmp_path / "p")
    export_segments(segments(spark, 6).coalesce(1), path, 1, Noting)
    assert int(open(f"{path}/v_Scenes_2/Scene_005.mp4").read()) >= 1


def test_a_failed_job_leaves_no_files(spark, tmp_path):
    path = str(tmp_path / "f")
    broken = segments(spark, 40).withColumn("dur", F.when(F.col("seg") == 33, F.raise_error(F.lit("the source breaks")).cast("double")).otherwise(1.0)).withColumn("data", F.lit(b"abc"))
    with pytest.raises(Exception, match="the source breaks"):
        spark.dataSource.register(SegmentExport)
        broken.write.format("segments").option("path", path).mode("append").save()
    assert exported(path) == [] and export_progress(path)["failed"] == 0


def test_a_task_that_outlives_its_job_leaves_no_files(tmp_path, monkeypatch):
    monkeypatch.setattr("segmill.sources.export.TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rows = [Row(folder="v", name=f"Scene_{i}.mp4", dur=1.0, data=b"abc") for i in range(6)]
    for abort_at in range(7):  # before the task's first row, between rows, after its last one
        path = str(tmp_path / str(abort_at))
        writer = SegmentExport({"path": path}).writer(None, False)
        assert not exported(path)

        def source():
            for i, row in enumerate(rows):
                if i == abort_at:
                    writer.abort([])
                    assert not exported(path)
                yield row
            if abort_at == len(rows):
                writer.abort([])

        with pytest.raises((RuntimeError, OSError)):
            writer.write(source())
        assert not exported(path) and export_progress(path) == {"done": 0, "failed": 0}
        assert not os.listdir(f"{path}/_results") and [os.path.getsize(f"{path}/_staging/{x}") for x in os.listdir(f"{path}/_staging")] == [0]
        with pytest.raises((RuntimeError, OSError)):  # one that starts after that
            writer.write(iter(rows))
        assert not exported(path) and not os.listdir(f"{path}/_results")
