"""Registered queries of the timeline operators over the driver's tables, and their oracle SQL.

The tables hold no videos, so ``events`` stands in: a user is a video, ``t`` counts hours since 2024-01-01 as seconds, and the score is
value / 500.  Every query runs over whole tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.functions import hashes, images, text
from segmill.operators import boundaries, decode, dedup, frames, intervals, model, queue, similar
from segmill.params import Options, valid_number
from segmill.plans import segments
from segmill.sources.tables import preference, score_log, score_scan
from segmill.streaming.min_gap import tumbling_counts

END = 720.0  # length of the stand-in videos
SMART = Options(sensitivity=0.75, min_duration=10.0)
ADAPTIVE = Options(sensitivity=0.75, min_duration=10.0, adaptive=True)
TYPES = ["click", "error", "purchase", "signup", "view"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    t = F.round((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3.6e9, 3)
    kind = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1
    bits = F.least(F.lit(62), F.floor(F.col("value") / 8)).cast("int")
    p = F.call_function("shiftleft", F.expr("1L"), bits) - 1
    c = F.call_function("shiftleft", F.expr("33L"), kind.cast("int"))
    return e.select(F.col("user_id").alias("video_id"), "event_id", t.alias("pts_time"), (F.col("value") / 500).alias("scene"), p.alias("p"), c.alias("c"))


def exploded(df: DataFrame, times) -> DataFrame:
    return df.select("video_id", F.explode(times).alias("t"))


def score_scan_q(spark, sf_dir):
    out = score_scan(timeline(spark, sf_dir), 0.25, 0.0, 200.0)
    return out.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.min("pts_time").alias("first_t"))


def min_gap_cuts(spark, sf_dir):
    g = segments.marks(timeline(spark, sf_dir))
    return exploded(g, boundaries.detected(segments.times_above(F.col("marks"), 0.1), 10.0))


def long_min_gap_cuts(spark, sf_dir):
    rows = timeline(spark, sf_dir).select("video_id", F.when(F.col("scene") > 0.1, F.col("pts_time")).alias("t"))
    return boundaries.long_min_gap(rows, "video_id", "t", 10.0)


def enforce_gap(spark, sf_dir):
    g = segments.marks(timeline(spark, sf_dir))
    return exploded(g, boundaries.enforce_gap(segments.times_above(F.col("marks"), 0.1), 10.0))


def adaptive_cuts(spark, sf_dir):
    return exploded(segments.stamps(segments.marks(timeline(spark, sf_dir)), ADAPTIVE), "stamps")


def _rescanned(spark, sf_dir):
    return segments.stamps(segments.marks(timeline(spark, sf_dir)), ADAPTIVE, head=True)


def head_rescan(spark, sf_dir):
    return exploded(_rescanned(spark, sf_dir), "stamps")


def intervals_q(spark, sf_dir):
    pieces = intervals.long_enough(intervals.intervals(F.col("stamps"), F.lit(END)))
    out = _rescanned(spark, sf_dir).select("video_id", F.explode(pieces).alias("s"))
    return out.select("video_id", "s.t", F.round("s.dur", 3).alias("dur"))


def dedup_segments(spark, sf_dir):
    g = timeline(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("pts_time", "event_id", "p", "c"))).alias("m"))
    end = lambda i: F.when(i + 1 < F.size("m"), F.get("m", i + 1)["pts_time"]).otherwise(END)
    cands = F.transform("m", lambda x, i: F.struct(x["pts_time"].alias("t"), (end(i) - x["pts_time"]).alias("dur"), x["p"].alias("p"), x["c"].alias("c")))
    out = g.select("video_id", F.posexplode(dedup.merge_drop_new(intervals.long_enough(cands))).alias("seg", "s"))
    return out.select("video_id", F.col("seg").cast("long").alias("seg"), "s.t", F.round("s.dur", 3).alias("dur"), "s.parts")


def smart_pipeline(spark, sf_dir):
    out = segments.smart_segments(timeline(spark, sf_dir), F.lit(END), SMART)
    return out.select("video_id", "seg", "t", F.round("dur", 3).alias("dur"), "parts")


def fixed_slices(spark, sf_dir):
    users = timeline(spark, sf_dir).groupBy("video_id").agg(F.max("pts_time").alias("duration"))
    return intervals.fixed_slices(users, 60.0).withColumn("dur", F.round("dur", 3))


def task_names(spark, sf_dir):
    segs = fixed_slices(spark, sf_dir)
    path = F.concat(F.lit("/media/"), F.col("video_id").cast("string"), F.lit(".mp4"))
    out = F.concat(intervals.output_dir(path), F.lit("/"), intervals.scene_name(F.col("seg"), F.col("t")))
    command = intervals.cut_command(path, out, F.col("t"), F.lit(60.0), True, F.lit("libx264"), F.lit(False))
    return segs.select("video_id", "seg", intervals.scene_name(F.col("seg"), F.col("t")).alias("name"), intervals.output_dir(path).alias("folder"), command.alias("command"))


def near_anti_join(spark, sf_dir):
    t = timeline(spark, sf_dir)
    weak, strong = t.where("scene <= 0.5").select("video_id", "event_id", "pts_time"), t.where("scene > 0.5").select("video_id", "pts_time")
    return boundaries.range_anti_join(weak, strong, "video_id", "pts_time", 0.3)


def neighbours(spark, sf_dir):
    t = timeline(spark, sf_dir)
    points, marks = t.where("scene <= 0.5").select("video_id", "pts_time"), t.where("scene > 0.5").select("video_id", "pts_time").distinct()
    out = boundaries.neighbours(points, marks, "video_id", "pts_time")
    return out.select("video_id", F.col("pts_time").alias("t"), "previous", F.when(F.col("next") < float("inf"), F.col("next")).alias("next"))


def mean_bits_hash(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", hashes.mean_bits(F.col("embedding")).alias("p"))


def hamming_pairs(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", hashes.mean_bits(F.col("embedding")).alias("p"))
    return similar.pairs_within(e, "vec_id", "p", 20, "label")


def dct_8x8(spark, sf_dir):
    out = images.coefficients(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", "u", "v", (F.round("coef", 6) + 0.0).alias("coef"))


def pictures(spark, sf_dir) -> DataFrame:
    """Embeddings as frames of 16 x 16 pixels: component k mod 64 gives pixel k; red grows with it, green falls, blue is half of red."""
    shade = F.transform(F.slice("embedding", 1, 64), lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1) * 127.5))).cast("int"))
    code = F.transform(shade, lambda s: F.concat(F.lpad(F.hex(s), 2, "0"), F.lpad(F.hex(255 - s), 2, "0"), F.lpad(F.hex(F.floor(s / 2).cast("int")), 2, "0")))
    data = F.unhex(F.repeat(F.array_join(code, ""), F.lit(4)))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("video_id"), F.lit(0).cast("long").alias("idx"), F.lit(16).alias("height"), F.lit(16).alias("width"), F.lit("rgb24").alias("mode"), data.alias("data"))


def picture_prints(spark, sf_dir):
    """Grey, bicubic resize, low frequencies and bits of the picture hash; resize, levels and bits of the colour hash."""
    return images.fingerprints(pictures(spark, sf_dir))


def score_islands(spark, sf_dir):
    cut = decode.score_islands(_frames(spark, sf_dir), 0.1).where(F.col("centre") / 25.0 > decode.FIRST_CUT)
    return cut.select("video_id", F.col("first").alias("first_i"), F.col("last").alias("last_i"), "centre", (F.col("centre") / 25.0).alias("sec"))


def _frames(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("video_id").orderBy("pts_time", "event_id")).cast("long") - 1
    return timeline(spark, sf_dir).select("video_id", n.alias("frame_no"), F.col("scene").alias("score"))


def cut_spacing(spark, sf_dir):
    return decode.decode_cuts(_frames(spark, sf_dir), 0.1, 10.0)


def model_windows(spark, sf_dir):
    return decode.model_windows(_frames(spark, sf_dir)).select("video_id", "window", F.col("slot").cast("long").alias("slot"), "frame_no")


def frame_batches(spark, sf_dir):
    return _frames(spark, sf_dir).groupBy("video_id", decode.batch_number(F.col("frame_no")).alias("batch")).agg(F.count(F.lit(1)).alias("n"))


def frame_lookup(spark, sf_dir):
    t = timeline(spark, sf_dir)
    fr = t.select("video_id", "pts_time", "event_id")
    wanted = t.select("video_id", F.col("event_id").alias("idx"), (F.col("pts_time") - 0.1).alias("t"))
    return frames.first_frame_after(wanted, fr, "event_id").select("video_id", "idx", F.col("event_id").alias("frame"))


def url_clean(spark, sf_dir):
    return text.distinct_links(read(spark, sf_dir, "pages"), "page_id", "url").select("page_id", F.col("pos").cast("long").alias("pos"), "url")


def text_readings(spark, sf_dir):
    """Clock, percent and path functions over texts made from orders."""
    o = read(spark, sf_dir, "orders")
    clock = F.format_string("Duration: %02d:%02d:%02d.50, x", F.col("o_orderkey") % 24, F.col("o_custkey") % 60, F.col("o_orderkey") % 60)
    line = F.concat(F.lit("[download]  "), (F.col("o_orderkey") % 1000 / 10).cast("string"), F.lit("% of"))
    path = F.concat(F.lit("/in/"), F.col("o_orderstatus"), F.lit("."), F.when(F.col("o_orderkey") % 2 == 0, "MP4").otherwise("webm"))
    return o.select("o_orderkey", text.clock_seconds(clock).alias("seconds"), text.percent(line).alias("pct"), text.is_video(path).alias("video"), text.extension(path).alias("ext"), text.stem(path).alias("stem"), text.directory(path).alias("folder"))


def channel_hist(spark, sf_dir):
    return images.histograms(pictures(spark, sf_dir)).withColumn("share", F.round("share", 9))


def capacity_q(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 33).alias("cores"), (F.col("c_custkey") % 65).alias("gb"), (F.col("c_nationkey") % 2 == 0).alias("hw"))
    return c.select("c_custkey", queue.capacity(F.col("cores"), F.col("gb"), F.col("hw")).alias("n"))


def run_metrics(spark, sf_dir):
    g = segments.stamps(segments.marks(timeline(spark, sf_dir)), SMART)
    segs = smart_pipeline(spark, sf_dir).groupBy("video_id").agg(F.count(F.lit(1)).alias("tasks"), F.sum(F.round(F.col("dur") * 1000).cast("long")).alias("millis"))
    out = g.select("video_id", F.size("stamps").cast("long").alias("stamps")).join(segs, "video_id")
    return out.select("video_id", "stamps", "tasks", "millis", F.round(intervals.filter_rate(F.col("tasks"), F.col("stamps")), 6).alias("rate"))


def _files(spark, sf_dir) -> DataFrame:
    """Orders as files: two of three are .mp4, in either case of letters."""
    suffix = F.element_at(F.array(F.lit(".mp4"), F.lit(".MP4"), F.lit(".webm")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("/in/o"), F.col("o_orderkey").cast("string"), suffix).alias("path"), F.col("o_orderdate").alias("modificationTime"))


def newest_order(spark, sf_dir):
    return queue.newest(_files(spark, sf_dir)).select("path")


def intake_q(spark, sf_dir):
    return queue.intake(_files(spark, sf_dir).withColumnRenamed("o_orderkey", "pos"))


def still_queued(spark, sf_dir):
    """Done customers' orders, as long as the customer is in the queue (here: of the first market segments)."""
    c = read(spark, sf_dir, "customer").where("c_mktsegment < 'C'").select(F.col("c_custkey").alias("o_custkey"))
    return queue.still_queued(read(spark, sf_dir, "orders"), c, "o_custkey").select("o_orderkey", "o_custkey")


def encoder_q(spark, sf_dir):
    """Per nation: the working encoder of the highest priority, suppliers standing in for encoders; and the tool found first."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("encoder"), F.col("s_suppkey").alias("priority"), (F.col("s_acctbal") > 5000).alias("works"))
    tools = s.select((F.col("priority") % 3).alias("level"), F.col("priority").alias("candidate"), F.col("encoder").alias("path"))
    found = queue.first_existing(tools, s.where("works").select(F.col("encoder").alias("path")), "ffmpeg").withColumnRenamed("path", "tool")
    last = queue.last_existing_line(s.select(F.col("priority").alias("line_no"), F.col("encoder").alias("line")), s.where("not works").select(F.col("encoder").alias("path"))).withColumnRenamed("path", "last")
    return queue.encoder_choice(s).crossJoin(found).crossJoin(last)  # one row each


def text_checks(spark, sf_dir):
    """Contains, number, range and blank checks, first error lines, names and messages, over texts made from orders."""
    k = F.col("o_orderkey")
    number = F.concat((k % 7 - 3).cast("string"), F.lit(".5"))
    whole = F.concat(F.lit(" "), (k % 20).cast("string"), F.lit(" "))
    lines = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.when((k + i) % 4 == 0, " ").otherwise(F.concat(F.lit("e"), i.cast("string"))))
    link = F.when(k % 3 == 0, F.lit("see HTTP://x")).otherwise(F.lit("none"))
    engine = F.element_at(F.array(F.lit("content"), F.lit("adaptive"), F.lit("precise"), F.lit("?")), (k % 4 + 1).cast("int"))
    wish = F.element_at(F.array(F.lit("auto"), F.lit("zh"), F.lit("en")), (k % 3 + 1).cast("int"))
    system = F.when(k % 2 == 0, "ZH").otherwise("fr")
    log = F.concat(F.lit("Duration: 00:01:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(", start"))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", text.has_link(link).alias("link"), text.positive(number).alias("positive"), valid_number(whole, 1, 16, whole=True).alias("threads"),
        text.is_blank(F.repeat(F.lit(" "), (k % 3).cast("int"))).alias("blank"), text.is_blank(F.when(k % 5 > 0, " x")).alias("missing"), text.error_text(lines).alias("errors"),
        text.engine_name(engine).alias("engine"), text.language(wish, system).alias("lang"), preference(F.concat(F.lit(" "), F.upper(wish), F.lit("\n"))).alias("setting"),
        text.formatted(F.lit("{0} of {1} done, {0}"), k % 9, F.col("o_custkey")).alias("message"), text.duration(F.when(k % 2 == 0, number), log).alias("seconds"),
    )


def log_scores(spark, sf_dir):
    """Score log lines made from the timeline, every third of another kind."""
    kind = F.when(F.col("event_id") % 3 == 0, "[showinfo] n:1 pts_time:").otherwise(F.when(F.col("event_id") % 3 == 1, "[showinfo] pts:").otherwise("[other] pts_time:"))
    whole = F.floor("pts_time").cast("long").cast("string")
    lines = timeline(spark, sf_dir).select("event_id", F.concat(kind, whole, F.lit(".25 x")).alias("value"))
    return score_log(lines).select("event_id", "pts_time")


def frame_fallback(spark, sf_dir):
    """Frames from the batch lookup (every second frame can be read there), else from the single one."""
    t = timeline(spark, sf_dir)
    fr = t.select("video_id", "pts_time", "event_id")
    wanted = t.select("video_id", F.col("event_id").alias("idx"), F.col("pts_time").alias("t"))
    batch = frames.first_frame_after(wanted, fr.where("event_id % 2 = 0"), "event_id")
    single = frames.first_frame_after(wanted, fr.where("event_id % 3 > 0"), "event_id")
    return frames.with_fallback(wanted, batch, single, "event_id").select("video_id", "idx", F.col("event_id").alias("frame"))


def thumbnails_q(spark, sf_dir):
    t = timeline(spark, sf_dir)
    videos = t.select("video_id").distinct()
    moved = t.select("video_id", (F.col("pts_time") / 100).alias("pts_time"), "event_id")
    return frames.thumbnails(videos, moved, "event_id").select("video_id", F.col("event_id").alias("frame"))


def shade_pixels(score: Column, pixels: int) -> Column:
    """Raw rgb24 pixels of one shade, 250 times the score: a number over a pixel's three bytes, as scores pass 1 and a byte holds 255 only."""
    return F.unhex(F.repeat(F.lpad(F.hex(F.floor(score * 250).cast("int")), 6, "0"), F.lit(pixels)))


def _shades(spark, sf_dir) -> DataFrame:
    """The timeline's frames at the model's size, each of one shade."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("video_id").orderBy("pts_time", "event_id")).cast("long") - 1
    rgb = shade_pixels(F.col("scene"), model.HEIGHT * model.WIDTH)
    return timeline(spark, sf_dir).select(F.col("video_id").cast("string").alias("video_id"), n.alias("frame_no"), rgb.alias("rgb"))


def first_shades(x: np.ndarray) -> np.ndarray:
    """The first pixel's shade of each frame over 255, in the shape [windows, frames]."""
    return (np.rint(x[:, :, 0, 0] * np.float32(255)) @ np.array([65536, 256, 1], np.float32)).astype(np.float32) / np.float32(255)


def _first_pixel():
    """A fixed scorer in place of a model: the first pixel's shade, in the shape [windows, frames, 1]."""
    return lambda x: first_shades(x)[..., None]


def model_scores(spark, sf_dir):
    out = model.score_frames(_shades(spark, sf_dir), _first_pixel)
    return out.select("video_id", "frame_no", F.round(F.col("score").cast("double"), 6).alias("score"))


def model_cuts(spark, sf_dir):
    return model.detect(_shades(spark, sf_dir), _first_pixel, threshold=0.5, fps=10.0)


def tumbling(spark, sf_dir):
    out = tumbling_counts(read(spark, sf_dir, "events"), width="1 day")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def folders(spark, sf_dir):
    """Output folders of files in a folder, right under the root, and bare names."""
    base = F.concat(F.lit("a"), F.col("p_partkey").cast("string"), F.lit(".mp4"))
    path = F.concat(F.element_at(F.array(F.lit(""), F.lit("/"), F.lit("/x/y/"), F.lit("C:\\v\\")), (F.col("p_partkey") % 4 + 1).cast("int")), base)
    return read(spark, sf_dir, "part").select("p_partkey", text.directory(path).alias("folder"), intervals.output_dir(path).alias("out"))


def many_links(spark, sf_dir):
    """Texts with several links: marks at their ends, repeats in other letters, quotes."""
    u = F.col("url")
    body = F.concat(F.lit("see "), u, F.lit(",; "), F.upper(F.substring(u, 1, 0)), F.regexp_replace(u, "^http://www", "http://WWW"), F.lit(', "'), u, F.lit("?x=1\" <"), u, F.lit("?x=2>;"))
    return text.distinct_links(read(spark, sf_dir, "pages").select("page_id", body.alias("body")), "page_id", "body").select("page_id", F.col("pos").cast("long").alias("pos"), "url")


def queue_left(spark, sf_dir):
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return queue.remove(s, n, "s_nationkey").select("s_suppkey", "s_nationkey")


def localised_status(spark, sf_dir):
    catalog = spark.createDataFrame([("O", "进行中", "open"), ("F", "完成", "done")], "key string, zh string, en string")
    out = text.localised(read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("key")), catalog, "key", F.lit("zh"))
    return out.select("o_orderkey", "text")


def detector_rules(spark, sf_dir):
    from segmill import params

    s = F.col("l_discount") * 10
    out = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", params.threshold(s).alias("t"), params.clamp_seconds(F.col("l_quantity") * 20 - 50).alias("gap"))
    return out.withColumn("near", params.adaptive_gap(F.col("gap")))


def queries() -> dict:
    return {
        "smart_pipeline": smart_pipeline, "score_scan": score_scan_q, "min_gap_cuts": min_gap_cuts, "long_min_gap_cuts": long_min_gap_cuts, "enforce_gap": enforce_gap,
        "adaptive_cuts": adaptive_cuts, "head_rescan": head_rescan, "intervals": intervals_q, "dedup_segments": dedup_segments, "fixed_slices": fixed_slices,
        "task_names": task_names, "near_anti_join": near_anti_join, "neighbours": neighbours, "mean_bits_hash": mean_bits_hash, "hamming_pairs": hamming_pairs,
        "dct_8x8": dct_8x8, "score_islands": score_islands, "cut_spacing": cut_spacing, "model_windows": model_windows, "frame_batches": frame_batches,
        "frame_lookup": frame_lookup, "url_clean": url_clean, "text_readings": text_readings, "channel_hist": channel_hist, "capacity": capacity_q,
        "picture_prints": picture_prints, "intake": intake_q, "still_queued": still_queued, "encoder": encoder_q, "text_checks": text_checks, "log_scores": log_scores,
        "frame_fallback": frame_fallback, "thumbnails": thumbnails_q, "model_scores": model_scores, "model_cuts": model_cuts, "tumbling": tumbling, "folders": folders, "many_links": many_links,
        "run_metrics": run_metrics, "newest_order": newest_order, "queue_left": queue_left, "localised_status": localised_status, "detector_rules": detector_rules,
    }


# ---- oracle SQL -------------------------------------------------------------------------------------------------

_TL = """tl AS (SELECT user_id AS video_id, event_id, round((epoch_us(ts) - 1704067200000000) / 3.6e9, 3) AS t, value / 500 AS scene,
    (CAST(1 AS BIGINT) << CAST(least(62, floor(value / 8)) AS INTEGER)) - 1 AS p,
    CAST(33 AS BIGINT) << CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INTEGER) AS c FROM events),
    vid AS (SELECT DISTINCT video_id FROM tl)"""


def _greedy(name: str, source: str, gap: float, op: str, zero: bool) -> str:
    """CTE of kept times: from 0, or from the first time, the next one at the gap."""
    seed = "SELECT video_id, CAST(0 AS DOUBLE) AS t FROM vid" if zero else f"SELECT video_id, min(t) AS t FROM {source} GROUP BY video_id"
    return f"{name} AS ({seed} UNION ALL SELECT r.video_id, min(s.t) FROM {name} r JOIN {source} s ON s.video_id = r.video_id AND s.t - r.t {op} {gap} GROUP BY r.video_id)"


def _zero(name: str, source: str) -> str:
    return f"{name} AS (SELECT video_id, t FROM {source} UNION ALL SELECT v.video_id, CAST(0 AS DOUBLE) FROM vid v LEFT JOIN (SELECT video_id, min(t) AS m FROM {source} GROUP BY 1) f USING (video_id) WHERE f.m IS NULL OR f.m > 0.1)"


def _far(name: str, a: str, b: str, d: float) -> str:
    return f"{name} AS (SELECT a.video_id, a.t FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {b} b WHERE b.video_id = a.video_id AND abs(a.t - b.t) < {d}))"


_PRIMARY = ["q1 AS (SELECT video_id, t FROM tl WHERE scene > 0.25)", _greedy("primary_", "q1", 10, ">", True)]
_ADAPTIVE = [*_PRIMARY, "q2 AS (SELECT video_id, t FROM tl WHERE scene > 0.163)", _greedy("sensitive", "q2", 5, ">", True), _far("far", "sensitive", "primary_", 10), _greedy("extra", "far", 10, ">=", False), "merged AS (SELECT * FROM primary_ UNION ALL SELECT * FROM extra WHERE t IS NOT NULL)"]


def _head(base: str) -> list[str]:
    return ["q3 AS (SELECT video_id, t FROM tl WHERE scene > 0.05 AND t < 20)", _greedy("head0", "q3", 10, ">", True), _far("head1", "head0", base, 0.3), f"all_ AS (SELECT * FROM {base} UNION ALL SELECT * FROM head1)", _greedy("spaced", "all_", 10, ">=", False), _zero("stamps", "spaced")]


_PIECES = f"pieces AS (SELECT video_id, t, coalesce(lead(t) OVER (PARTITION BY video_id ORDER BY t), {END}) - t AS dur FROM stamps)"


def _with(parts: list[str], select: str) -> str:
    return "WITH RECURSIVE " + _TL + ", " + ", ".join(parts) + " " + select


#: The merge/drop/new rule over cand(video_id, i, t, dur, p, c), i from 1.
_RULE = """r AS (SELECT video_id, CAST(0 AS BIGINT) AS i, false AS open, CAST(0 AS BIGINT) AS lp, CAST(0 AS BIGINT) AS lc, CAST([] AS STRUCT(p BIGINT, c BIGINT)[]) AS acc, CAST(-1 AS BIGINT) AS seg, 'none' AS act FROM vid
    UNION ALL SELECT video_id, i, act <> 'drop', CASE WHEN act = 'new' THEN p ELSE lp END, CASE WHEN act = 'new' THEN c ELSE lc END,
        CASE WHEN act = 'new' THEN list_append(acc, {'p': p, 'c': c}) ELSE acc END, seg + CASE WHEN act = 'new' THEN 1 ELSE 0 END, act
    FROM (SELECT r.video_id, k.i, k.p, k.c, r.lp, r.lc, r.acc, r.seg,
        CASE WHEN r.open AND bit_count(xor(k.p, r.lp)) <= 3 AND bit_count(xor(k.c, r.lc)) <= 2 THEN 'merge'
             WHEN len(list_filter(r.acc, lambda q: bit_count(xor(q.p, k.p)) <= 5 AND bit_count(xor(q.c, k.c)) <= 3)) > 0 THEN 'drop' ELSE 'new' END AS act
        FROM r JOIN cand k ON k.video_id = r.video_id AND k.i = r.i + 1)),
    segs AS (SELECT r.video_id, r.seg, min(k.t) AS t, sum(k.dur) AS dur, count(*) AS parts FROM r JOIN cand k USING (video_id, i) WHERE r.act IN ('new', 'merge') GROUP BY 1, 2)"""
_SMART = [*_PRIMARY, *_head("primary_"), _PIECES,
    "cand AS (SELECT x.video_id, row_number() OVER (PARTITION BY x.video_id ORDER BY x.t) AS i, x.t, x.dur, f.p, f.c FROM (SELECT * FROM pieces WHERE dur >= 0.5) x JOIN LATERAL (SELECT tl.p, tl.c FROM tl WHERE tl.video_id = x.video_id AND tl.t >= x.t AND tl.t < x.t + 0.2 ORDER BY tl.t, tl.scene, tl.p LIMIT 1) f ON true)", _RULE]
_FRAMES = "fr AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) - 1 AS i, scene AS score FROM tl)"
_ISLANDS = [_FRAMES, "ab AS (SELECT video_id, i, i - row_number() OVER (PARTITION BY video_id ORDER BY i) AS g FROM fr WHERE score >= 0.1)", "isl AS (SELECT video_id, min(i) AS first_i, max(i) AS last_i, (min(i) + max(i)) // 2 AS centre FROM ab GROUP BY video_id, g)"]
_BITS = "h AS (SELECT vec_id, label, list_sum(list_transform(range(0, 63), lambda i: CASE WHEN CAST(e[i + 1] AS DOUBLE) > m THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END)) - CASE WHEN CAST(e[64] AS DOUBLE) > m THEN CAST(9223372036854775808 AS HUGEINT) ELSE 0 END AS p FROM (SELECT vec_id, label, embedding AS e, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / 64 AS m FROM embeddings))"
_SLICES = "sl AS (SELECT video_id, k AS seg, k * 60.0 AS t, least(60.0, d - k * 60.0) AS dur FROM (SELECT video_id, max(t) AS d FROM tl GROUP BY 1), LATERAL (SELECT unnest(range(0, CAST(ceil(d / 60.0) AS BIGINT))) AS k))"


_PIXELS = """px AS (SELECT video_id, pos, s AS r, 255 - s AS g, s // 2 AS b FROM (SELECT vec_id AS video_id, p AS pos, CAST(least(255, greatest(0, floor((CAST(embedding[p % 64 + 1] AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS s FROM embeddings, range(256) z(p)))"""
#: Low frequencies of a side of 16 pixels made 32 by cubic weights (a = -0.5, edges repeated): basis(k, x, w).
_CUBIC = """tap AS (SELECT i, least(15, greatest(0, j)) AS x, CASE WHEN d <= 1 THEN 1.5 * d ** 3 - 2.5 * d ** 2 + 1 WHEN d < 2 THEN -0.5 * d ** 3 + 2.5 * d ** 2 - 4 * d + 2 ELSE 0 END AS w
        FROM (SELECT i, j, abs(j - ((i + 0.5::DOUBLE) / 2 - 0.5)) AS d FROM range(32) a(i), range(-4, 20) c(j))),
    basis AS (SELECT k, x, sum(CASE WHEN k = 0 THEN sqrt(1 / 32.0::DOUBLE) ELSE sqrt(2 / 32.0::DOUBLE) END * cos((2 * i + 1) * k * pi() / 64) * w / t) AS w FROM tap JOIN (SELECT i, sum(w) AS t FROM tap GROUP BY 1) USING (i), range(8) z(k) GROUP BY 1, 2)"""
_FILES = "f AS (SELECT o_orderkey, o_orderdate, s, concat('/in/o', o_orderkey, s) AS path FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MP4' ELSE '.webm' END AS s FROM orders))"


def oracle_sql() -> dict[str, str]:
    return {
        "score_scan": _with(["x AS (SELECT 1)"], "SELECT video_id, count(*) AS n, min(t) AS first_t FROM tl WHERE scene > 0.25 AND t >= 0 AND t < 200 GROUP BY 1"),
        "min_gap_cuts": _with(["q AS (SELECT video_id, t FROM tl WHERE scene > 0.1)", _greedy("k", "q", 10, ">", True)], "SELECT video_id, t FROM k"),
        "long_min_gap_cuts": _with(["q AS (SELECT video_id, t FROM tl WHERE scene > 0.1)", _greedy("k", "q", 10, ">", True)], "SELECT video_id, t FROM k"),
        "enforce_gap": _with(["q AS (SELECT video_id, t FROM tl WHERE scene > 0.1)", _greedy("k", "q", 10, ">=", False), _zero("z", "k")], "SELECT video_id, t FROM z"),
        "adaptive_cuts": _with(_ADAPTIVE, "SELECT video_id, t FROM merged"),
        "head_rescan": _with([*_ADAPTIVE, *_head("merged")], "SELECT video_id, t FROM stamps"),
        "intervals": _with([*_ADAPTIVE, *_head("merged"), _PIECES], "SELECT video_id, t, round(dur, 3) AS dur FROM pieces WHERE dur >= 0.5"),
        "dedup_segments": _with(
            [f"d AS (SELECT *, coalesce(lead(t) OVER w, {END}) - t AS dur FROM tl WINDOW w AS (PARTITION BY video_id ORDER BY t, event_id))", "cand AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS i, t, dur, p, c FROM d WHERE dur >= 0.5)", _RULE],
            "SELECT video_id, seg, t, round(dur, 3) AS dur, parts FROM segs",
        ),
        "smart_pipeline": _with(_SMART, "SELECT video_id, seg, t, round(dur, 3) AS dur, parts FROM segs"),
        "fixed_slices": _with([_SLICES], "SELECT video_id, seg, CAST(t AS DOUBLE) AS t, CAST(round(dur, 3) AS DOUBLE) AS dur FROM sl WHERE dur >= 0.5"),
        "task_names": _with([_SLICES], """SELECT video_id, seg, n AS name, f AS folder, concat('-y -ss ', printf('%.3f', CAST(t AS DOUBLE)), ' -t 60.000 -i "/media/', video_id, '.mp4" -c:v libx264 -an "', f, '/', n, '"') AS command
            FROM (SELECT *, printf('Scene_%03d_%.2fs.mp4', seg, CAST(t AS DOUBLE)) AS n, concat('/media/', video_id, '_Scenes') AS f FROM sl WHERE dur >= 0.5)"""),
        "near_anti_join": _with(["x AS (SELECT 1)"], "SELECT video_id, event_id, t AS pts_time FROM tl a WHERE scene <= 0.5 AND NOT EXISTS (SELECT 1 FROM tl b WHERE b.scene > 0.5 AND b.video_id = a.video_id AND abs(a.t - b.t) < 0.3)"),
        "neighbours": _with(["m AS (SELECT DISTINCT video_id, t FROM tl WHERE scene > 0.5)"], """SELECT a.video_id, a.t, coalesce((SELECT max(m.t) FROM m WHERE m.video_id = a.video_id AND m.t < a.t), 0) AS previous,
            (SELECT min(m.t) FROM m WHERE m.video_id = a.video_id AND m.t > a.t) AS next FROM tl a WHERE scene <= 0.5"""),
        "mean_bits_hash": f"WITH {_BITS} SELECT vec_id, CAST(p AS BIGINT) AS p FROM h",
        "hamming_pairs": f"WITH {_BITS}, b AS (SELECT vec_id, label, CAST(p AS BIGINT) AS p FROM h) SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.p, y.p)) AS BIGINT) AS distance FROM b x JOIN b y ON x.label = y.label AND x.vec_id < y.vec_id WHERE bit_count(xor(x.p, y.p)) <= 20",
        "dct_8x8": """WITH b AS (SELECT k, x, CASE WHEN k = 0 THEN sqrt(1 / 8.0) ELSE sqrt(2 / 8.0) END * cos((2 * x + 1) * k * pi() / 16) AS w FROM range(8) a(k), range(8) c(x)),
            e AS (SELECT vec_id, unnest(embedding[1:64]) AS z, unnest(range(64)) AS pos FROM embeddings)
            SELECT vec_id, u.k AS u, v.k AS v, round(sum(CAST(z AS DOUBLE) * u.w * v.w), 6) + 0.0 AS coef FROM e JOIN b u ON u.x = pos // 8 JOIN b v ON v.x = pos % 8 GROUP BY 1, 2, 3""",
        "score_islands": _with(_ISLANDS, "SELECT video_id, first_i, last_i, centre, centre / 25.0 AS sec FROM isl WHERE centre / 25.0 > 0.05"),
        "cut_spacing": _with([*_ISLANDS, "s AS (SELECT video_id, CAST(centre AS DOUBLE) / 10 AS t FROM isl WHERE CAST(centre AS DOUBLE) / 10 > 0.05)", _greedy("k", "s", 0.25, ">", False)], "SELECT video_id, t FROM k"),
        "model_windows": _with([_FRAMES, "n AS (SELECT video_id, max(i) + 1 AS n FROM fr GROUP BY 1)"], "SELECT video_id, w AS \"window\", s AS slot, least(n - 1, w * 100 + s) AS frame_no FROM (SELECT video_id, n, unnest(range(0, CAST(ceil(n / 100.0) AS BIGINT))) AS w FROM n), range(100) z(s)"),
        "frame_batches": _with([_FRAMES], "SELECT video_id, i // 24 AS batch, count(*) AS n FROM fr GROUP BY 1, 2"),
        "frame_lookup": _with(["w AS (SELECT video_id, event_id AS idx, greatest(0, t - 0.1) AS s FROM tl)"], "SELECT w.video_id, w.idx, (SELECT arg_min(event_id, t) FROM tl WHERE tl.video_id = w.video_id AND tl.t >= w.s AND tl.t < w.s + 0.2) AS frame FROM w"),
        "url_clean": r"""SELECT page_id, CAST(0 AS BIGINT) AS pos, rtrim(regexp_extract(url, 'https?://[^\s"''<>]+'), ',;') AS url FROM pages""",
        "text_readings": """SELECT o_orderkey, CAST((o_orderkey % 24) * 3600 + (o_custkey % 60) * 60 + (o_orderkey % 60) + 0.5 AS DOUBLE) AS seconds, CAST(o_orderkey % 1000 AS DOUBLE) / 10 AS pct,
            o_orderkey % 2 = 0 AS video, CASE WHEN o_orderkey % 2 = 0 THEN 'MP4' ELSE 'WEBM' END AS ext, o_orderstatus AS stem, '/in' AS folder FROM orders""",
        "channel_hist": f"""WITH {_PIXELS}, n AS (SELECT video_id, channel, level, count(*) AS n FROM (SELECT video_id, unnest([0, 1, 2]) AS channel, unnest([r, g, b]) // 32 AS level FROM px) GROUP BY 1, 2, 3)
            SELECT CAST(v.vec_id AS VARCHAR) AS video_id, CAST(0 AS BIGINT) AS idx, CAST(c AS BIGINT) AS channel, CAST(l AS BIGINT) AS level, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) / 768.0::DOUBLE, 9) AS share
            FROM embeddings v, range(3) a(c), range(8) d(l) LEFT JOIN n ON n.video_id = v.vec_id AND n.channel = c AND n.level = l""",
        "picture_prints": f"""WITH {_PIXELS}, {_CUBIC},
            coef AS (SELECT video_id, u.k AS u, v.k AS v, sum((0.299 * r + 0.587 * g + 0.114 * b) / 255 * u.w * v.w) AS z FROM px JOIN basis u ON u.x = pos // 16 JOIN basis v ON v.x = pos % 16 GROUP BY 1, 2, 3),
            mean AS (SELECT video_id, avg(z) AS m FROM coef GROUP BY 1),
            p AS (SELECT video_id, sum(CASE WHEN z > m THEN CASE WHEN u * 8 + v = 63 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(CAST(1 AS BIGINT) << CAST(u * 8 + v AS INTEGER) AS HUGEINT) END ELSE 0 END) AS p FROM coef JOIN mean USING (video_id) GROUP BY 1),
            n AS (SELECT video_id, channel, level, count(*) AS n FROM (SELECT video_id, unnest([0, 1, 2]) AS channel, unnest([r, g, b]) // 32 AS level FROM px) GROUP BY 1, 2, 3),
            c AS (SELECT video_id, sum(CASE WHEN n > 32 THEN 1 << CAST(channel * 8 + level AS INTEGER) ELSE 0 END) AS c FROM n GROUP BY 1)
            SELECT CAST(video_id AS VARCHAR) AS video_id, CAST(0 AS BIGINT) AS idx, CAST(p AS BIGINT) AS p, CAST(c AS BIGINT) AS c FROM p JOIN c USING (video_id)""",
        "intake": f"""WITH {_FILES} SELECT o_orderkey AS pos, path, concat('o', o_orderkey, s) AS name, 'MP4' AS ext FROM f WHERE o_orderkey % 3 < 2""",
        "still_queued": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment < 'C')",
        "encoder": """SELECT coalesce((SELECT s_name FROM supplier WHERE s_acctbal > 5000 ORDER BY s_suppkey LIMIT 1), 'libx264') AS encoder,
            coalesce((SELECT s_name FROM supplier WHERE s_acctbal > 5000 ORDER BY s_suppkey % 3, s_suppkey LIMIT 1), 'ffmpeg') AS tool, (SELECT s_name FROM supplier WHERE NOT s_acctbal > 5000 ORDER BY s_suppkey DESC LIMIT 1) AS last""",
        "text_checks": f"""WITH k AS (SELECT o_orderkey, o_custkey, o_orderkey AS k, o_orderkey % 7 - 3 + CASE WHEN o_orderkey % 7 < 3 THEN -0.5 ELSE 0.5 END AS num FROM orders)
            SELECT o_orderkey, k % 3 = 0 AS link, CAST(CASE WHEN num > 0 THEN num END AS DOUBLE) AS positive, CAST(CASE WHEN k % 20 BETWEEN 1 AND 16 THEN k % 20 END AS INTEGER) AS threads, true AS blank, k % 5 = 0 AS missing,
            array_to_string(list_transform(list_filter(range(1, 26), lambda i: (k + i) % 4 <> 0)[1:20], lambda i: concat('e', i)), chr(10)) AS errors,
            CASE k % 4 WHEN 1 THEN '{text.ENGINES["adaptive"]}' WHEN 2 THEN '{text.ENGINES["precise"]}' ELSE '{text.ENGINES["content"]}' END AS engine,
            CASE WHEN k % 3 = 1 THEN 'zh' WHEN k % 3 = 2 THEN 'en' WHEN k % 2 = 0 THEN 'zh' ELSE 'en' END AS lang, CASE k % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'zh' ELSE 'en' END AS setting,
            concat(k % 9, ' of ', o_custkey, ' done, ', k % 9) AS message, CAST(CASE WHEN k % 2 = 0 AND num > 0 THEN num ELSE 60 + k % 60 END AS DOUBLE) AS seconds FROM k""",
        "log_scores": _with(["x AS (SELECT 1)"], "SELECT event_id, floor(t) + 0.25 AS pts_time FROM tl WHERE event_id % 3 = 0"),
        "frame_fallback": _with(["w AS (SELECT video_id, event_id AS idx, greatest(0, t) AS s FROM tl)"], """SELECT w.video_id, w.idx, coalesce(
            (SELECT arg_min(event_id, t) FROM tl WHERE event_id % 2 = 0 AND tl.video_id = w.video_id AND tl.t >= w.s AND tl.t < w.s + 0.2),
            (SELECT arg_min(event_id, t) FROM tl WHERE event_id % 3 > 0 AND tl.video_id = w.video_id AND tl.t >= w.s AND tl.t < w.s + 0.2)) AS frame FROM w"""),
        "thumbnails": _with(["m AS (SELECT video_id, event_id, t / 100 AS t FROM tl)"], """SELECT v.video_id, coalesce((SELECT arg_min(event_id, t) FROM m WHERE m.video_id = v.video_id AND m.t >= 1.0 AND m.t < 1.0 + 0.2),
            (SELECT arg_min(event_id, t) FROM m WHERE m.video_id = v.video_id AND m.t >= 0.1 AND m.t < 0.1 + 0.2)) AS frame FROM vid v"""),
        "model_scores": _with([_FRAMES], "SELECT CAST(video_id AS VARCHAR) AS video_id, i AS frame_no, round(CAST(CAST(CAST(floor(score * 250) AS FLOAT) / CAST(255 AS FLOAT) AS FLOAT) AS DOUBLE), 6) AS score FROM fr"),
        "model_cuts": _with(["fr AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) - 1 AS i, CAST(CAST(floor(scene * 250) AS FLOAT) / CAST(255 AS FLOAT) AS DOUBLE) AS score FROM tl)", *(x.replace("score >= 0.1", "score >= 0.5") for x in _ISLANDS[1:]),
            "s AS (SELECT video_id, CAST(centre AS DOUBLE) / 10 AS t FROM isl WHERE CAST(centre AS DOUBLE) / 10 > 0.05)", _greedy("k", "s", 0.25, ">", False)], "SELECT CAST(video_id AS VARCHAR) AS video_id, t FROM k"),
        "tumbling": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "folders": r"""SELECT p_partkey, f AS folder, concat(CASE WHEN f = '/x/y' OR f = 'C:\v' THEN concat(f, '/') ELSE f END, 'a', p_partkey, '_Scenes') AS out
            FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '/x/y' ELSE 'C:\v' END AS f FROM part)""",
        "many_links": "SELECT page_id, CAST(k AS BIGINT) AS pos, CASE k WHEN 0 THEN url ELSE concat(url, '?x=', k) END AS url FROM pages, range(3) a(k)",
        "capacity": """WITH x AS (SELECT c_custkey, c_custkey % 33 AS cores, c_custkey % 65 AS gb, c_nationkey % 2 = 0 AS hw FROM customer),
            y AS (SELECT *, least(greatest(1, cores // 2), CASE WHEN gb <= 0 THEN 4 WHEN gb < 8 THEN 1 WHEN gb < 12 THEN 2 WHEN gb < 16 THEN 3 WHEN gb < 32 THEN 6 ELSE 16 END) AS n FROM x)
            SELECT c_custkey, CAST(greatest(1, CASE WHEN hw THEN least(n, CASE WHEN gb >= 32 THEN 5 ELSE 3 END) ELSE n END) AS BIGINT) AS n FROM y""",
        "run_metrics": _with(_SMART, """SELECT video_id, s.n AS stamps, g.n AS tasks, g.millis, round((1 - g.n / greatest(1, s.n)) * 100, 6) AS rate FROM (SELECT video_id, count(*) AS n FROM stamps GROUP BY 1) s
            JOIN (SELECT video_id, count(*) AS n, CAST(sum(CAST(round(round(dur, 3) * 1000) AS BIGINT)) AS BIGINT) AS millis FROM segs GROUP BY 1) g USING (video_id)"""),
        "newest_order": f"WITH {_FILES} SELECT path FROM f WHERE o_orderkey % 3 < 2 ORDER BY o_orderdate DESC, path LIMIT 1",
        "queue_left": "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
        "localised_status": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN '进行中' WHEN 'F' THEN '完成' ELSE o_orderstatus END AS text FROM orders",
        "detector_rules": "SELECT *, greatest(0.5, gap * 0.5) AS near FROM (SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 1 - l_discount * 10)), 3) AS t, greatest(1, least(600, l_quantity * 20 - 50)) AS gap FROM lineitem)",
    }
