"""Hand tables for each rule, and random timelines against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from segmill.operators import boundaries as B
from segmill.operators.decode import decode_cuts
from segmill.operators.intervals import cut_command, fixed_slices, intervals, long_enough, output_dir, scene_name
from segmill.params import Options


def arr(xs):
    return F.array(*[F.lit(float(x)) for x in xs]) if xs else B.no_times()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_strict_and_inclusive_gap(spark):
    assert value(spark, B.detected(arr([10.0, 10.001, 20.0, 20.002]), 10)) == [0, 10.001, 20.002]
    assert value(spark, B.enforce_gap(arr([20, 0, 19, 10]), 10)) == [0, 10, 20]


def test_zero_start(spark):
    assert value(spark, B.enforce_gap(arr([0.05, 12]), 1)) == [0.05, 12]
    assert value(spark, B.enforce_gap(arr([0.2, 12]), 1)) == [0, 0.2, 12]
    assert value(spark, B.enforce_gap(arr([]), 1)) == [0]


def test_head_rescan(spark):
    assert value(spark, B.head_rescan(arr([0, 15, 40]), arr([12]), 10)) == [0, 12, 40]
    assert value(spark, B.head_rescan(arr([0, 15]), arr([0, 15.2]), 10)) == [0, 15]


def test_adaptive_merge(spark):
    assert value(spark, B.adaptive_merge(arr([0, 30]), arr([0, 6, 12, 18, 24, 33]), 10)) == [0, 12, 30]


def test_intervals(spark):
    got = value(spark, long_enough(intervals(arr([0, 5, 5.4, 9]), F.lit(9.3))))
    assert [(round(x.t, 3), round(x.dur, 3)) for x in got] == [(0, 5), (5.4, 3.6)]


def merged_by_lists(primary, sensitive, gap):
    """The rule as a scan: keep a sensitive time far from every time kept so far."""
    kept = list(primary)
    for t in sensitive:
        if all(abs(t - k) >= gap for k in kept):
            kept.append(t)
    return sorted(kept)


def test_adaptive_merge_on_random_timelines(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        times = sorted({round(rnd.uniform(0, 200), 1) for _ in range(rnd.randint(0, 30))})
        weak = sorted({round(rnd.uniform(0, 200), 1) for _ in range(rnd.randint(0, 60))})
        gap = rnd.choice([1.0, 5.0, 10.0])
        rows.append((i, [0.0, *times[1:]], weak, gap))
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>, g double")
    for r in df.select("i", B.adaptive_merge(F.col("a"), F.col("b"), F.col("g")).alias("x")).collect():
        assert r.x == merged_by_lists(*rows[r.i][1:])


def test_long_timelines_stream(spark):
    rnd = random.Random(4)
    rows = [(k, round(rnd.uniform(0, 300), 2)) for k in ("a", "b", "c") for _ in range(500)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, t double").repartition(5)
    native = df.groupBy("k").agg(B.detected(F.array_sort(F.collect_list("t")), 7.0).alias("x")).select("k", F.explode("x").alias("t"))
    assert sorted(map(tuple, B.long_min_gap(df, "k", "t", 7.0).collect())) == sorted(map(tuple, native.collect()))


def test_range_anti_join(spark):
    a = spark.createDataFrame([("v", 1.0), ("v", 1.3), ("v", 5.0), ("w", 1.0)], "k string, t double")
    b = spark.createDataFrame([("v", 1.25), ("v", 4.69), ("v", 5.31)], "k string, t double")
    assert sorted(map(tuple, B.range_anti_join(a, b, "k", "t", 0.3).collect())) == [("v", 5.0), ("w", 1.0)]


@pytest.mark.parametrize(("d", "want"), [(25.3, [(0, 10), (10, 10), (20, 5.3)]), (20.4, [(0, 10), (10, 10)]), (0.2, [])])
def test_fixed_slices(spark, d, want):
    got = fixed_slices(spark.createDataFrame([("v", d)], "video_id string, duration double"), 10).collect()
    assert [(r.t, round(r.dur, 3)) for r in got] == want


def test_fixed_slices_need_a_duration(spark):
    with pytest.raises(Exception, match="positive"):
        fixed_slices(spark.createDataFrame([("v", 0.0)], "video_id string, duration double"), 10).collect()


def test_options():
    assert (Options(sensitivity=0.75).threshold, Options(sensitivity=0.75).adaptive_threshold) == (0.25, 0.163)
    assert (Options(sensitivity=1.0).threshold, Options(sensitivity=1.0).adaptive_threshold) == (0, 0.02)
    assert (Options(min_duration=0.1).gap, Options(min_duration=999).gap, Options(min_duration=1.0).adaptive_gap) == (1, 600, 0.5)


def test_decode(spark):
    score = {10: 0.7, 11: 0.8, 20: 0.9}
    df = spark.createDataFrame([("v", i, score.get(i, 0.0)) for i in range(30)], "video_id string, frame_no long, score float")
    assert sorted(r.t for r in decode_cuts(df, 0.5, 10).collect()) == [1.0, 2.0]
    ones = spark.createDataFrame([("v", i, 1.0 if i in (0, 10, 14, 20) else 0.0) for i in range(30)], "video_id string, frame_no long, score float")
    assert sorted(r.t for r in decode_cuts(ones, 0.5, 25).collect()) == [0.4, 0.8]


def test_names_and_commands(spark):
    assert value(spark, scene_name(F.lit(7), F.lit(12.345))) == "Scene_007_12.35s.mp4"
    assert value(spark, output_dir(F.lit("/a/b.c.mp4"))) == "/a/b.c_Scenes"
    got = value(spark, cut_command(F.lit("/i.mp4"), F.lit("/o.mp4"), F.lit(1.0), F.lit(2.5), False, F.lit("h264_qsv"), F.lit(True)))
    assert got == '-y -hwaccel auto -ss 1.000 -t 2.500 -i "/i.mp4" -c:v h264_qsv -c:a aac "/o.mp4"'


def test_lower_bound(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        items = sorted((rnd.choice([None, *[round(rnd.uniform(0, 9), 1) for _ in range(9)]]) for _ in range(rnd.choice([0, 1, 2, 3, 7, 8, 9, 40]))), key=lambda x: -1 if x is None else x)
        rows.append((i, [(x, 1) for x in items], [rnd.uniform(-1, 10), items[0] if items and items[0] is not None else 5.0, 99.0]))
    df = spark.createDataFrame(rows, "i int, items array<struct<t: double, x: int>>, ask array<double>")
    for r in df.select("items", "ask", F.transform("ask", lambda v: B.lower_bound(F.col("items"), "t", v)).alias("got")).collect():
        assert r.got == [next((k for k, y in enumerate(r["items"]) if y.t is not None and y.t >= v), len(r["items"])) for v in r.ask]
