"""Streams out of order give the table's result once the watermark has passed; a query goes on from its checkpoint."""

import os
import random

import pytest
from pyspark.sql import functions as F

from segmill.operators import boundaries, dedup
from segmill.streaming.ordered import stream_cuts, stream_segments

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def stateful(spark):
    before = {k: spark.conf.get(k, None) for k in (PROVIDER, "spark.sql.shuffle.partitions")}
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrive(spark, rows, schema, folder, names, at):
    """Each list of rows becomes a file; files are taken in the order of their times."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{names}{i}")
        for root, _, files in os.walk(f"{folder}/{names}{i}"):
            for f in files:
                os.utime(os.path.join(root, f), (at + i * 10, at + i * 10))


def run(spark, build, schema, folder):
    """Takes all files that are there, one per micro-batch, and stops; a further call goes on from the checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    q = build(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def shuffled(rnd, rows, spread, parts):
    """Rows in batches, each at most ``spread`` seconds away from its place in time."""
    order = sorted(rows, key=lambda r: r[1] + rnd.uniform(0, spread))
    step = -(-len(order) // parts)
    return [order[i : i + step] for i in range(0, len(order), step)]


def test_cuts(stateful, tmp_path):
    spark, folder, rnd = stateful, str(tmp_path), random.Random(5)
    schema = "video_id string, pts_time double, scene double"
    rows = [(v, round(rnd.uniform(0, 300), 2), rnd.random()) for v in "abc" for _ in range(120)] + [("quiet", 100.0, 0.1)]
    batches = shuffled(rnd, rows, 20, 6)
    arrive(spark, batches[:3], schema, f"{folder}/in", "x", 1_700_000_000)

    def build(s):
        return stream_cuts(s, 7.5, 0.5, "20 seconds")

    run(spark, build, schema, folder)
    some = spark.read.parquet(f"{folder}/out").count()
    end = [[("z", 10_000.0, 0.1)], [("late", 50.0, 0.9), ("a", 299.99, 0.9)], [("z", 10_001.0, 0.1)]]
    arrive(spark, [*batches[3:], *end], schema, f"{folder}/in", "y", 1_700_000_100)
    run(spark, build, schema, folder)  # from the checkpoint
    table = spark.createDataFrame([*rows, ("z", 10_000.0, 0.1)], schema)
    grouped = table.groupBy("video_id").agg(F.array_sort(F.collect_list(F.when(F.col("scene") > 0.5, F.col("pts_time")))).alias("ts"))
    want = grouped.select("video_id", F.explode(boundaries.detected(F.col("ts"), 7.5)).alias("pts_time"))
    got = spark.read.parquet(f"{folder}/out")
    assert 4 < some < got.count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_segments(stateful, tmp_path):
    spark, folder, rnd = stateful, str(tmp_path), random.Random(6)
    schema = "video_id string, t double, dur double, p long, c long"
    rows = []
    for v in "ab":
        p, c = 0, 0
        for i in range(80):
            if rnd.random() < 0.4:
                p, c = rnd.choice([0, -1, 0x0F0F0F0F, -(2**63), 2**40 - 1]), rnd.choice([0, 255, 2**23])
            rows.append((v, i * 2.5, 2.5, p ^ (1 << rnd.randint(0, 62)), c ^ rnd.choice([0, 1, 3])))
    rows += [("a", 33.3, 1.0, None, 1), ("b", None, 1.0, 1, 1)]
    timed = [r for r in rows if r[1] is not None]
    batches = [*shuffled(rnd, timed, 15, 5), [("b", None, 1.0, 1, 1)], [("z", 1000.0, 1.0, 5, 5)], [("z", 5000.0, 1.0, 5, 5)], [("z", 5001.0, 1.0, 5, 5)]]
    arrive(spark, batches, schema, f"{folder}/in", "x", 1_700_000_000)
    run(spark, lambda s: stream_segments(s, "15 seconds", 60.0), schema, folder)
    table = spark.createDataFrame(timed, schema).where("p is not null")
    grouped = table.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("t", "dur", "p", "c"))).alias("m"))
    want = grouped.select("video_id", F.posexplode(dedup.merge_drop_new(F.col("m"))).alias("seg", "s")).select("video_id", "seg", "s.t", "s.dur", "s.parts")
    got = spark.read.parquet(f"{folder}/out")
    assert sorted(map(tuple, got.where("video_id <> 'z'").collect())) == sorted(map(tuple, want.collect()))
    assert [tuple(r) for r in got.where("video_id = 'z'").collect()] == [("z", 0, 1000.0, 1.0, 1)]  # idle for over a minute: given out, and begun anew
