import pytest
from pyspark.sql import functions as F

from segmill import params
from segmill.functions import text as T
from segmill.operators import frames, queue
from segmill.sources import sinks, tables
from segmill.streaming.min_gap import tumbling_counts


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_links(spark):
    s = 'http://A.com/x, https://b.org;; "http://c" http://a.com/X'
    df = spark.createDataFrame([(1, s), (2, None), (3, "none")], "id int, s string")
    assert [r.url for r in T.distinct_links(df, "id", "s").orderBy("id", "pos").collect()] == ["http://A.com/x", "https://b.org", "http://c"]
    assert value(spark, T.has_link(F.lit("see HTTP://x"))) is True


def test_readings(spark):
    lit = F.lit
    assert value(spark, T.clock_seconds(lit("  Duration: 01:02:03.50, start"))) == 3723.5 and value(spark, T.clock_seconds(lit("no"))) is None
    assert value(spark, T.percent(lit("[download]  45.3% of"))) == 45.3 and value(spark, T.percent(lit("[download] 45% of"))) is None and value(spark, T.percent(lit("45.3%"))) is None
    assert [value(spark, T.is_video(lit(p))) for p in ("a.MP4", "b.webm", "c", "d.x/mp4")] == [True, False, False, False]
    assert value(spark, T.stem(lit(r"C:\a\b.c.mp4"))) == "b.c" and value(spark, T.directory(lit("/a/b/c.mp4"))) == "/a/b"
    assert value(spark, T.duration(lit("0"), lit("Duration: 0:00:02"))) == 2 and value(spark, T.duration(lit("7.5"), lit(None).cast("string"))) == 7.5
    with pytest.raises(Exception, match="no duration"):
        value(spark, T.duration(lit("x"), lit("y")))
    assert value(spark, T.error_text(F.array(lit(" "), lit("a"), lit(None), lit("b")))) == "a\nb"
    assert [value(spark, T.language(lit(p), lit(s))) for p, s in (("auto", "ZH"), ("auto", "fr"), ("en", "zh"))] == ["zh", "en", "en"]
    assert [value(spark, T.engine_name(lit(e))) for e in ("content", "adaptive", "?")] == [T.ENGINES[k] for k in ("content", "adaptive", "content")]
    assert value(spark, T.formatted(lit("{0} of {1}"), lit(1), lit("x"))) == "1 of x"
    assert [value(spark, params.valid_number(lit(x), 1, 16, True)) for x in ("16", "0", "x", "17")] == [16, None, None, None]
    assert value(spark, params.threshold(lit(0.75))) == 0.25 and value(spark, params.adaptive_threshold(lit(0.75))) == 0.163
    assert [value(spark, tables.preference(lit(x))) for x in (" ZH ", "de")] == ["zh", "auto"]


def test_localised(spark):
    catalog = spark.createDataFrame([("a", "甲", "A")], "key string, zh string, en string")
    got = T.localised(spark.createDataFrame([("a",), ("b",)], "k string"), catalog, "k", F.lit("en")).collect()
    assert sorted((r.k, r.text) for r in got) == [("a", "A"), ("b", "b")]


def test_queue(spark):
    q = queue.intake(spark.createDataFrame([(1, "/x/a.mp4"), (2, "/x/a.mp4"), (3, "/x/b.txt"), (4, "/x/c.MKV")], "pos int, path string"))
    assert [(r.name, r.ext) for r in q.orderBy("pos").collect()] == [("a.mp4", "MP4"), ("a.mp4", "MP4"), ("c.MKV", "MKV")]
    gone = q.where("name = 'c.MKV'")
    assert queue.remove(q, gone, "pos").count() == 2 and queue.still_queued(q, gone, "pos").count() == 1
    files = spark.createDataFrame([("/a.mp4", 1), ("/b.mp4", 5), ("/c.txt", 9)], "path string, modificationTime int")
    assert queue.newest(files).first().path == "/b.mp4"
    cand = spark.createDataFrame([(1, 0, "p"), (0, 1, "q"), (0, 0, "r")], "level int, candidate int, path string")
    assert queue.first_existing(cand, spark.createDataFrame([("p",), ("q",)], "path string"), "d").first().path == "q"
    assert queue.first_existing(cand, spark.createDataFrame([], "path string"), "d").first().path == "d"
    assert queue.last_existing_line(spark.createDataFrame([(1, "p"), (2, "q"), (3, "z")], "line_no int, line string"), spark.createDataFrame([("p",), ("q",)], "path string")).first().path == "q"
    works = spark.createDataFrame([("nvenc", 1, False), ("qsv", 2, True), ("amf", 3, True)], "encoder string, priority int, works boolean")
    assert queue.encoder_choice(works).first().encoder == "qsv" and queue.encoder_choice(works.where("false")).first().encoder == "libx264"
    caps = [value(spark, queue.capacity(F.lit(c), F.lit(m), F.lit(h))) for c, m, h in ((16, 0, False), (16, 7, False), (16, 40, True), (64, 64, False), (1, 64, False), (16, 20, True))]
    assert caps == [4, 1, 5, 16, 1, 3]


def test_frames(spark):
    wanted = spark.createDataFrame([("v", 0, -1.0), ("v", 1, 0.95), ("v", 2, 5.0)], "video_id string, idx int, t double")
    fr = spark.createDataFrame([("v", 0.0, "a"), ("v", 1.0, "b"), ("v", 1.1, "c"), ("v", 5.2, "d"), ("w", 5.1, "e")], "video_id string, pts_time double, img string")
    got = frames.first_frame_after(wanted, fr, "img")
    assert {r.idx: r.img for r in got.collect()} == {0: "a", 1: "b", 2: None}
    single = spark.createDataFrame([("v", 2, "s"), ("v", 1, "t")], "video_id string, idx int, img string")
    assert {r.idx: r.img for r in frames.with_fallback(wanted, got, single, "img").collect()} == {0: "a", 1: "b", 2: "s"}
    videos = spark.createDataFrame([("v",), ("w",), ("x",)], "video_id string")
    low = spark.createDataFrame([("v", 1.05, "b"), ("v", 0.1, "z"), ("w", 0.15, "y")], "video_id string, pts_time double, img string")
    assert {r.video_id: r.img for r in frames.thumbnails(videos, low, "img").collect()} == {"v": "b", "w": "y", "x": None}


def test_sources_and_sinks(spark, tmp_path):
    logs = spark.createDataFrame([("[showinfo] n:1 pts_time:1.25 x",), ("pts_time:3",), ("showinfo none",)], "value string")
    assert [r.pts_time for r in tables.score_log(logs).collect()] == [1.25]
    tasks = spark.createDataFrame([("v", 0, 1.5), ("w", 0, 2.0)], "video_id string, seg int, dur double")
    assert sinks.write_tasks(tasks, f"{tmp_path}/out", 0) == {"tasks": 2, "seconds": 3.5}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    sinks.write_preference(spark.createDataFrame([("zh",)], "preference string"), f"{tmp_path}/lang")
    assert spark.read.text(f"{tmp_path}/lang").first().value == "zh"
    assert tables.files(spark, f"{tmp_path}/lang", "*.txt").count() == 1
    scores = spark.createDataFrame([(1.0, 0.25), (2.0, 0.2501), (30.0, 0.9)], "pts_time double, scene double")
    assert tables.score_scan(scores, 0.25, 0, 20).count() == 1


def test_tumbling_windows(spark):
    ev = spark.sql("SELECT timestamp_ntz'2024-01-01 00:10:00' ts, 'click' event_type, 1.0D value UNION ALL SELECT timestamp_ntz'2024-01-01 01:10:00', 'click', 2.0D")
    assert [r.n for r in tumbling_counts(ev).collect()] == [1, 1]


def test_folders_of_bare_names(spark):
    from segmill.operators.intervals import output_dir

    rows = spark.createDataFrame([("a.mp4",), ("/a.mp4",), ("/x/a.b.mp4",), ("C:\\v\\a.mp4",)], "p string")
    got = [tuple(r) for r in rows.select(T.directory(F.col("p")), output_dir(F.col("p"))).collect()]
    assert got == [("", "a_Scenes"), ("/", "/a_Scenes"), ("/x", "/x/a.b_Scenes"), ("C:\\v", "C:\\v/a_Scenes")]


def test_of_frames_at_one_time_the_least_is_taken(spark):
    fr = spark.createDataFrame([("v", 1.05, 3), ("v", 1.05, 1), ("v", 1.05, 2), ("v", 1.1, 0), ("v", 0.15, 9), ("v", 0.15, 8)], "video_id string, pts_time double, img int")
    for order in ("img", F.desc("img")):  # whichever comes last
        given = fr.coalesce(1).orderBy(order)
        wanted = spark.createDataFrame([("v", 1, 1.0), ("v", 2, 0.1)], "video_id string, idx int, t double")
        got = frames.first_frame_after(wanted, given, "img")
        assert {r.idx: r.img for r in got.collect()} == {1: 1, 2: 8}
        batch, single = frames.first_frame_after(wanted.where("idx = 2"), given, "img"), frames.first_frame_after(wanted, given.where("img % 2 = 1"), "img")
        assert {r.idx: r.img for r in frames.with_fallback(wanted, batch, single, "img").collect()} == {1: 1, 2: 8}
        assert frames.thumbnails(wanted.select("video_id").distinct(), given, "img").first().img == 1


def test_repeated_rows_fall_back_once_each(spark):
    rows = [("v", 1, 1.0), ("v", 1, 1.0), ("v", 1, 5.0), ("v", 2, None), ("v", 2, None)]
    wanted = spark.createDataFrame(rows, "video_id string, idx int, t double")
    fr = spark.createDataFrame([("v", 1.0, 4), ("v", 1.0, 4), ("v", 5.1, 3), ("v", 0.0, 7)], "video_id string, pts_time double, img int")
    batch, single = frames.first_frame_after(wanted, fr.where("img % 2 = 0"), "img"), frames.first_frame_after(wanted, fr.where("img % 2 = 1"), "img")
    got = frames.with_fallback(wanted, batch, single, "img").collect()
    assert sorted((r.idx, r.t or 0.0, r.img) for r in got) == [(1, 1.0, 4), (1, 1.0, 4), (1, 5.0, 3), (2, 0.0, 7), (2, 0.0, 7)]
