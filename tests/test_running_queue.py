"""The running queue: every file once, in order, across restarts and repeated batches."""

import os

from segmill.operators.queue import in_order, intake
from segmill.streaming.queue import batch_writer, queue_table, take_files


def put(folder, name, at):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(name.encode())
    os.utime(path, (at, at))


def names(spark, table):
    return [r["name"] for r in in_order(queue_table(spark, table)).collect()]


def run(spark, root, per_batch=2):
    q = take_files(spark, f"{root}/in", f"{root}/queue", f"{root}/cp", per_batch)
    assert q.awaitTermination(120) and q.exception() is None


def test_each_file_once_and_in_order_across_restarts(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    for i, name in enumerate(["z.mp4", "a.MKV", "notes.txt", "m.mov", "b.mp4"]):
        put(tmp_path / "in", name, 1_700_000_000 + i)
    run(spark, tmp_path)
    assert names(spark, f"{tmp_path}/queue") == ["z", "a", "m", "b"] or names(spark, f"{tmp_path}/queue") == ["z.mp4", "a.MKV", "m.mov", "b.mp4"]
    first = names(spark, f"{tmp_path}/queue")
    for i, name in enumerate(["c.mp4", "0.mp4"]):
        put(tmp_path / "in", name, 1_700_001_000 + i)
    run(spark, tmp_path)  # goes on from the checkpoint
    run(spark, tmp_path)  # nothing new
    got = names(spark, f"{tmp_path}/queue")
    assert got[:4] == first and [n.split(".")[0] for n in got[4:]] == ["c", "0"]
    assert in_order(queue_table(spark, f"{tmp_path}/queue"), 1).first()["name"] == got[0]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    table = str(tmp_path / "queue")
    files = spark.createDataFrame([("/in/a.mp4", 1), ("/in/b.mp4", 2)], "path string, length long").selectExpr("path", "timestamp_seconds(length) modificationTime", "length")
    for batch in (0, 1, 1):
        batch_writer(table)(files.where(f"length = {batch + 1}"), batch)
    assert [(r.path, r.batch) for r in in_order(queue_table(spark, table)).collect()] == [("/in/a.mp4", 0), ("/in/b.mp4", 1)]


def test_order_of_a_table(spark):
    rows = spark.createDataFrame([(3, "/x/c.mp4"), (1, "/x/b.mp4"), (2, "/x/a.txt"), (1, "/x/a.mp4")], "pos int, path string").repartition(3)
    assert [r.path for r in in_order(intake(rows)).collect()] == ["/x/a.mp4", "/x/b.mp4", "/x/c.mp4"]
