"""The ordered rules within one long timeline, against the rules that take a timeline as a whole, and against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.operators import boundaries, decode, ranged
from segmill.operators.frames import first_frame_after


def kept(times, last, gap, strict):
    out = []
    for t in times:
        if t - last > gap if strict else t - last >= gap:
            out.append(t)
            last = t
    return out


def test_entry_tables():
    rnd = random.Random(0)
    for _ in range(3000):
        gap, strict = rnd.choice([0.1, 0.3, 1, 2.5, 7]), rnd.random() < 0.5
        t = np.unique([round(rnd.uniform(0, rnd.choice([1, 5, 20])), rnd.choice([1, 3])) for _ in range(rnd.randint(1, 30))]) + rnd.choice([0, 0.1, 100.3])
        rows = list(zip(*(x.tolist() for x in ranged.entry_table(t, gap, strict)), strict=True))
        for entry in (-math.inf, t[0], t[0] - rnd.choice([0.05, gap, gap / 2, gap * 1.5]), t[0] - rnd.random() * gap):

            def far(x, entry=entry):
                return x - entry > gap if strict else x - entry >= gap

            got = [(a, last) for a, after, until, last in rows if (math.isnan(after) or not far(after)) and far(until)]
            want = kept(t.tolist(), entry, gap, strict)
            assert sorted(a for a, _ in got) == want and [a for a, last in got if last] == want[-1:]


def timelines(spark, seed, hot=4000):
    """One timeline with most rows, short ones, one without times, one of a null key; repeats and times that are none."""
    rnd = random.Random(seed)
    rows = [("hot", round(rnd.uniform(-5, 900), 2)) for _ in range(hot)] + [("hot", 77.25)] * 500 + [("hot", None), ("hot", float("nan")), ("hot", float("inf"))]
    rows += [(f"k{rnd.randint(0, 30)}", round(rnd.uniform(0, 100), 1)) for _ in range(300)] + [("none", None), (None, 3.0), (None, 20.0), (None, 20.05)]
    rnd.shuffle(rows)
    return spark.createDataFrame([(*r, "x") for r in rows], "video_id string, t double, range string").repartition(6)


@pytest.mark.parametrize(("gap", "strict", "zero"), [(0.3, True, True), (0.3, False, False), (25.0, True, True), (2000.0, True, False), (0.01, False, True)])
def test_same_as_one_task_per_timeline(spark, gap, strict, zero):
    rows = timelines(spark, int(gap * 10))
    finite = rows.withColumn("t", F.when(F.abs("t") < float("inf"), F.col("t")))
    want = boundaries.long_min_gap(finite, "video_id", "t", gap, strict, zero)
    for size in (50, 1_000_000):
        got = ranged.ranged_min_gap(rows, "video_id", "t", gap, strict, zero, ranges=5, rows_per_range=size)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_enforced_gap(spark):
    rows = timelines(spark, 3).where("t is null or abs(t) < 1000")
    grouped = rows.groupBy("video_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    want = grouped.select("video_id", F.explode(boundaries.enforce_gap(F.col("ts"), 2.5)).alias("t"))
    got = ranged.ranged_enforce_gap(rows, "video_id", "t", 2.5, ranges=4, rows_per_range=100)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty_and_wrong(spark):
    rows = spark.createDataFrame([], "video_id long, t double")
    assert ranged.ranged_min_gap(rows, "video_id", "t", 1.0).count() == 0 and ranged.ranged_enforce_gap(rows, "video_id", "t", 1.0).count() == 0
    assert ranged.ranged_neighbours(rows, rows, "video_id", "t").count() == 0
    with pytest.raises(ValueError):
        ranged.ranged_min_gap(rows, "video_id", "t", 0.0)


def test_one_timeline_is_many_tasks(spark):
    """A timeline of a million times: every range works, and none holds more than a part of the rows."""
    rows = spark.range(1_000_000).select(F.lit(1).alias("video_id"), (F.rand(3) * 100_000).alias("t"))
    got = ranged.ranged_min_gap(rows, "video_id", "t", 5.0, ranges=8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    files = {f for f in got.inputFiles() if "gap-tables" in f}
    assert len(files) == 8 and "gap-tables" not in plan.split("Join")[0]
    assert got.count() == boundaries.long_min_gap(rows, "video_id", "t", 5.0).count()


def test_neighbours(spark):
    rnd = random.Random(7)
    points = [("hot", round(rnd.uniform(0, 50), 1)) for _ in range(400)] + [("b", 1.0), ("c", 5.0), ("hot", 1e9), ("b", None)]
    marks = [("hot", round(rnd.choice([rnd.uniform(0, 5), rnd.uniform(30, 50)]), 1)) for _ in range(200)] + [("b", 1.0), ("b", 3.0), ("d", 9.0)]
    p, m = (spark.createDataFrame(x, "video_id string, t double") for x in (points, marks))
    got = ranged.ranged_neighbours(p, m, "video_id", "t", ranges=6).collect()
    want = []
    for k, t in points:
        own = [x for j, x in marks if j == k]
        want.append((k, t, None, None) if t is None else (k, t, max((x for x in own if x < t), default=0.0), min((x for x in own if x > t), default=math.inf)))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_first_frame(spark):
    rnd = random.Random(8)
    wanted = [("hot", i, round(rnd.uniform(-1, 60), 2), "w") for i in range(300)] + [("hot", 0, 5.0, "same idx"), ("b", 1, None, "w"), ("e", 2, 0.0, "w")]
    frames = [("hot", round(rnd.choice([rnd.uniform(0, 4), rnd.uniform(20, 60)]), 2), i) for i in range(500)] + [("hot", 2.0, 10_000 + i) for i in range(300)] + [("b", 0.1, 1), ("e", None, 3)]
    w = spark.createDataFrame(wanted, "video_id string, idx int, t double, extra string")
    f = spark.createDataFrame(frames, "video_id string, pts_time double, frame long")
    got = ranged.ranged_first_frame(w, f, "frame", 0.2, ranges=5).collect()
    want = []
    for v, i, t, x in wanted:
        s = max(0.0, t) if t is not None else 0.0
        hits = [(p, n) for u, p, n in frames if u == v and p is not None and s <= p < s + 0.2]
        want.append((v, i, t, x, min(hits)[1] if hits else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert w.where("idx > 0 and t is not null").count() == first_frame_after(w.where("idx > 0 and t is not null"), f, "frame").count()


def test_islands_and_cuts(spark):
    rnd = random.Random(9)
    scores = [("hot", i, rnd.choice([0.9, 0.9, 0.1])) for i in range(2000)] + [("long", i, 0.9) for i in range(170)] + [("gap", i, 0.9) for i in (0, 1, 9, 10, 19, 20, 21)] + [("gap", 10, 0.95), ("low", 0, 0.1)]
    df = spark.createDataFrame(scores, "video_id string, frame_no int, score double")
    whole = decode.score_islands(df.dropDuplicates(["video_id", "frame_no"]), 0.5).select("video_id", "first", "last", "centre")
    for size in (10, 64, 10**6):
        got = ranged.ranged_islands(df, 0.5, frames_per_range=size)
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(*(F.col(c).cast(got.schema[c].dataType) for c in got.columns)).collect()))
    assert sorted(map(str, ranged.ranged_cuts(df, 0.5, 25.0, ranges=4).collect())) == sorted(map(str, decode.decode_cuts(df.dropDuplicates(["video_id", "frame_no"]), 0.5, 25.0).collect()))


@pytest.mark.parametrize("adaptive", [False, True])
def test_whole_plan(spark, adaptive):
    """The plan over time ranges gives what the plan with a row per timeline gives."""
    from segmill.params import Options
    from segmill.plans.long_segments import long_smart_segments
    from segmill.plans.segments import smart_segments

    rnd = random.Random(21)
    rows = [(v, t / 4, rnd.choice([0.0, 0.1, 0.2, 0.3, 0.9]), (1 << rnd.randint(0, 30)) - 1, 255 << rnd.choice([0, 8])) for v, n in (("hot", 2400), ("b", 100), ("c", 30)) for t in range(n) if rnd.random() < 0.7]
    rows += [("quiet", 1.0, 0.0, 1, 1)]
    df = spark.createDataFrame(rows, "video_id string, pts_time double, scene double, p long, c long").repartition(5)
    o = Options(sensitivity=0.75, min_duration=4.0, adaptive=adaptive)
    want = smart_segments(df, F.lit(700.0), o, head=True)
    got = long_smart_segments(df, F.lit(700.0), o, head=True)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
