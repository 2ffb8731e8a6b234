"""Raw frame files: ranges as tasks, pushed conditions, broken ends, a round trip."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

from segmill.sources.frames import PUSHDOWN, FrameReader, PushingReader, frame_table, write_frames

SIZE = 4 * 2 * 3


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("videos")
    for name, n, tail in (("a.raw", 100, b""), ("b.raw", 7, b"broken"), ("empty.raw", 0, b""), ("short.raw", 0, b"x")):
        (root / name).write_bytes(b"".join(bytes([k % 256]) * SIZE for k in range(n)) + tail)
    (root / "_hidden").write_bytes(b"y" * SIZE)
    return str(root)


@pytest.fixture
def pushing(spark):
    spark.conf.set(PUSHDOWN, "true")
    yield spark
    spark.conf.unset(PUSHDOWN)


def options(folder, **more):
    return {"path": folder, "width": "4", "height": "2", **more}


def test_all_frames_in_many_tasks(spark, folder):
    df = frame_table(spark, folder, 4, 2, split_bytes=10 * SIZE)
    assert df.rdd.getNumPartitions() == 11
    got = df.collect()
    assert sorted((os.path.basename(r.video_id), r.frame_no) for r in got) == [("a.raw", n) for n in range(100)] + [("b.raw", n) for n in range(7)]
    assert all(bytes(r.rgb) == bytes([r.frame_no % 256]) * SIZE for r in got)
    both = frame_table(spark, f"{folder}/b.raw,{folder}/a.raw", 4, 2)
    assert both.rdd.getNumPartitions() == 1 and both.count() == 107  # short files share a task
    assert frame_table(spark, f"file://{folder}/b.raw", 4, 2).count() == 7
    assert frame_table(spark, f"{folder}/empty.raw", 4, 2).count() == 0


def test_one_task_reads_its_bytes_only(folder):
    reader = FrameReader(options(folder, splitBytes=str(10 * SIZE)))
    part = reader.partitions()[3]
    assert part.parts == [(f"{folder}/a.raw", 30, 40)]
    assert [r["frame_no"] for b in reader.read(part) for r in b.to_pylist()] == list(range(30, 40))


def test_pushed_conditions_choose_what_is_read(folder):
    reader = PushingReader(options(folder, splitBytes=str(10 * SIZE)))
    name = f"{folder}/a.raw"
    mine = [EqualTo(("video_id",), name), GreaterThanOrEqual(("frame_no",), 15), LessThan(("frame_no",), 22)]
    others = [IsNotNull(("frame_no",)), EqualTo(("rgb",), b"x"), In(("frame_no",), (16, 18))]
    assert list(reader.pushFilters([*mine, *others])) == others
    assert [p.parts for p in reader.partitions()] == [[(name, 16, 19)]]
    again = PushingReader(options(folder))
    list(again.pushFilters([GreaterThan(("frame_no",), 4), LessThanOrEqual(("frame_no",), 3)]))
    assert [b for p in again.partitions() for b in again.read(p)] == []


def test_pushed_through_spark(pushing, tmp_path):
    """A file of 40 GB (sparse): only a few frames of it can be read within a test."""
    path = str(tmp_path / "huge.raw")
    frame = 320 * 180 * 3
    with open(path, "wb") as f:
        f.truncate(40 * 10**9)
        f.seek(200_000 * frame)
        f.write(b"\7" * frame)
    df = frame_table(pushing, path, 320, 180)
    got = df.where((F.col("frame_no") >= 199_999) & (F.col("frame_no") <= 200_001) & (F.col("video_id") == path)).select("frame_no", F.substring("rgb", 1, 1).alias("b"))
    assert got.rdd.getNumPartitions() == 1
    assert [(r.frame_no, bytes(r.b)) for r in got.orderBy("frame_no").collect()] == [(199_999, b"\0"), (200_000, b"\7"), (200_001, b"\0")]
    assert df.where("frame_no = 200000 and length(rgb) > 5").count() == 1
    assert df.where("video_id = 'none'").count() == 0


def test_round_trip(spark, tmp_path):
    frames = spark.createDataFrame([(v, n, bytes([n, v]) * 12) for v in (1, 2) for n in range(20)] + [(None, 1, b"x" * 24), (1, 99, None)], "video_id long, frame_no long, rgb binary").repartition(5)
    told = {r.video_id: (r.path, r.frames) for r in write_frames(frames, str(tmp_path / "out")).collect()}
    assert {k: n for k, (_, n) in told.items()} == {"1": 20, "2": 20}
    back = frame_table(spark, str(tmp_path / "out"), 4, 2)
    assert sorted((r.video_id, r.frame_no, bytes(r.rgb)) for r in back.collect()) == sorted((told[str(v)][0], n, bytes([n, v]) * 12) for v in (1, 2) for n in range(20))


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        FrameReader({"path": str(tmp_path / "no"), "width": "1", "height": "1"}).partitions()
