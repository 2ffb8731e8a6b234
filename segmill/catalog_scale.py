"""Registered queries of the operators for hot timelines and other work that must spread over tasks, and their oracle SQL.

The events of every third user are one timeline here, so a third of all rows has one key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill import catalog as C
from segmill.functions import images
from segmill.functions.hashes import mean_bits
from segmill.functions.text import clock_seconds, duration, positive
from segmill.operators import dedup, frames, model, ranged, similar
from segmill.operators.intervals import scene_name
from segmill.params import valid_number
from segmill.plans.long_segments import long_smart_segments, long_stamps
from segmill.shared import shared_folder
from segmill.sources.export import export_results, export_segments
from segmill.sources.frames import frame_table, write_frames
from segmill.streaming.ordered import stream_cuts, stream_segments


def hot(spark, sf_dir) -> DataFrame:
    return C.timeline(spark, sf_dir).withColumn("video_id", F.when(F.col("video_id") % 3 == 0, 0).otherwise(F.col("video_id")))


def hot_gap_cuts(spark, sf_dir):
    rows = hot(spark, sf_dir).select("video_id", F.when(F.col("scene") > 0.1, F.col("pts_time")).alias("t"))
    return ranged.ranged_min_gap(rows, "video_id", "t", 0.5)


def hot_enforced_gap(spark, sf_dir):
    return ranged.ranged_enforce_gap(hot(spark, sf_dir).select("video_id", F.col("pts_time").alias("t")), "video_id", "t", 0.5)


def hot_neighbours(spark, sf_dir):
    t = hot(spark, sf_dir).select("video_id", F.col("pts_time").alias("t"), "scene")
    out = ranged.ranged_neighbours(t.where("scene <= 0.5").drop("scene"), t.where("scene > 0.5").drop("scene"), "video_id", "t")
    return out.withColumn("next", F.when(F.col("next") < float("inf"), F.col("next")))


def hot_frame_lookup(spark, sf_dir):
    t = hot(spark, sf_dir)
    wanted = t.select("video_id", F.col("event_id").alias("idx"), (F.col("pts_time") - 0.1).alias("t"))
    return ranged.ranged_first_frame(wanted, t.select("video_id", "pts_time", "event_id"), "event_id", frames.REACH).select("video_id", "idx", F.col("event_id").alias("frame"))


def _hot_frames(spark, sf_dir) -> DataFrame:
    """Frames of one timeline in the order of event_id, which are its numbers."""
    e = C.read(spark, sf_dir, "events")
    return e.select(F.lit(0).alias("video_id"), F.col("event_id").alias("frame_no"), (F.col("value") / 500).alias("score"))


def hot_islands(spark, sf_dir):
    return ranged.ranged_islands(_hot_frames(spark, sf_dir), 0.1, frames_per_range=1000)


def hot_cuts(spark, sf_dir):
    return ranged.ranged_cuts(_hot_frames(spark, sf_dir), 0.1, 10.0)


def frame_ranges(spark, sf_dir):
    """The timeline written as raw frames of 2 x 1 pixels, a file per user, and read back by ranges of 1,000 frames from the sixth on."""
    raw = C._frames(spark, sf_dir).withColumn("rgb", C.shade_pixels(F.col("score"), 2))
    folder = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    write_frames(raw, folder).write.format("noop").mode("overwrite").save()
    read = frame_table(spark, folder, 2, 1, split_bytes=6000).where("frame_no >= 5")
    video = F.regexp_extract("video_id", r"([0-9]+)\.raw$", 1).cast("long")
    return read.select(video.alias("video_id"), "frame_no", F.conv(F.hex(F.substring("rgb", 1, 3)), 16, 10).cast("long").alias("shade"))


def variants(spark, sf_dir) -> DataFrame:
    """Three hashes for each embedding: its own, one with 3 other bits and one with 5; vec_id * 3 + variant tells them apart."""
    e = C.read(spark, sf_dir, "embeddings").select("vec_id", mean_bits(F.col("embedding")).alias("p"))
    place = (F.col("vec_id") % 50).cast("int")
    flips = [F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(0b10101).cast("long"), place), F.call_function("shiftleft", F.lit(0b11111_0000_0000).cast("long"), place)]
    return e.select(F.posexplode(F.array(*[F.struct((F.col("vec_id") * 3 + i).alias("id"), F.col("p").bitwiseXOR(f).alias("p")) for i, f in enumerate(flips)]))).select("col.id", "col.p")


def hamming_near(spark, sf_dir):
    return similar.pairs_within(variants(spark, sf_dir), "id", "p", 8)


def hot_segments(spark, sf_dir):
    """All events of the hot timelines as candidates of one second."""
    cands = hot(spark, sf_dir).select("video_id", "event_id", F.col("pts_time").alias("t"), F.lit(1.0).alias("dur"), "p", "c")
    return dedup.long_merge_drop_new(cands, "video_id", ("t", "event_id"))


def wide_pictures(spark, sf_dir) -> DataFrame:
    """Embeddings as bgra frames of 24 rows of 40 pixels: pixel k is component 7 * k mod 64; red grows with it, green falls, blue is half of red."""
    mixed = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.get("embedding", k * 7 % 64))
    shade = F.transform(mixed, lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 1) * 127.5))).cast("int"))
    code = F.transform(shade, lambda s: F.concat(F.lpad(F.hex(F.floor(s / 2).cast("int")), 2, "0"), F.lpad(F.hex(255 - s), 2, "0"), F.lpad(F.hex(s), 2, "0"), F.lit("FF")))
    data = F.unhex(F.repeat(F.array_join(code, ""), F.lit(24 * 40 // 64)))
    return C.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("video_id"), F.lit(0).cast("long").alias("idx"), F.lit(24).alias("height"), F.lit(40).alias("width"), F.lit("bgra").alias("mode"), data.alias("data"))


def shrunk_hist(spark, sf_dir):
    return images.histograms(wide_pictures(spark, sf_dir)).select("video_id", "channel", "level", "n")


def shrunk_prints(spark, sf_dir):
    return images.fingerprints(wide_pictures(spark, sf_dir)).select("video_id", "p")


def model_odd_frames(spark, sf_dir):
    """Model scores where every seventh frame is null, every eleventh comes twice, and the output has one of four shapes, by the video."""
    shapes = [lambda a: a[..., None], lambda a: a, lambda a: a.reshape(-1, 1), lambda a: a.ravel()]
    frames_ = C._shades(spark, sf_dir).withColumn("rgb", F.when(F.col("frame_no") % 7 != 3, F.col("rgb")))
    rows = frames_.withColumn("again", F.explode(F.array_repeat(F.lit(1), F.when(F.col("frame_no") % 11 == 5, 2).otherwise(1)))).drop("again")
    parts = [model.score_frames(rows.where(F.pmod(F.col("video_id").cast("long"), F.lit(4)) == k), lambda shape=shape: lambda x: shape(C.first_shades(x))) for k, shape in enumerate(shapes)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.select("video_id", "frame_no", F.round(F.col("score").cast("double"), 6).alias("score"))


def export_report(spark, sf_dir):
    """Slices of the timelines exported as files in the shared folder, every fifth of a timeline without data: a result row for each."""
    slices = C.fixed_slices(spark, sf_dir).withColumn("folder", F.concat(F.lit("user_"), F.col("video_id").cast("string")))
    data = F.when(F.col("seg") % 5 != 4, F.concat_ws(" ", "video_id", "seg").cast("binary"))
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    export_segments(slices.select("folder", scene_name(F.col("seg"), F.col("t")).alias("name"), "dur", data.alias("data")), path, 4)
    return export_results(spark, path).withColumn("bytes", F.coalesce("bytes", F.lit(-1)))


def hot_smart_pipeline(spark, sf_dir):
    return long_smart_segments(hot(spark, sf_dir), F.lit(C.END), C.SMART).select("video_id", "seg", "t", F.round("dur", 3).alias("dur"), "parts")


def hot_adaptive_stamps(spark, sf_dir):
    return long_stamps(hot(spark, sf_dir), C.ADAPTIVE, head=True)


_STORE = "spark.sql.streaming.stateStore.providerClass"


def _streamed(spark, rows: DataFrame, build, time: str) -> DataFrame:
    """What a stream gives for rows that arrive in three parts, each with times from all over the timelines, and then two late marks of user -1 that move the watermark past them."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = rows.withColumn("part", F.pmod(F.xxhash64(time), F.lit(3)))
    marks = [rows.limit(1).withColumn("video_id", F.lit(-1).cast("long")).withColumn(time, F.lit(float(t))) for t in (10_000, 20_000)]
    for k, part in enumerate([rows.where(F.col("part") == k) for k in range(3)] + marks):
        part.drop("part").coalesce(1).write.parquet(f"{root}/in/{k}")
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
        out = build(stream)
        query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)
    return spark.read.schema(out.schema).parquet(f"{root}/out").where("video_id >= 0")


def streamed_cuts(spark, sf_dir):
    rows = C.timeline(spark, sf_dir).select("video_id", "pts_time", "scene")
    return _streamed(spark, rows, lambda s: stream_cuts(s, 10.0, 0.1, late="800 seconds"), "pts_time").withColumnRenamed("pts_time", "t")


def streamed_segments(spark, sf_dir):
    rows = C.timeline(spark, sf_dir).select("video_id", F.col("pts_time").alias("t"), F.lit(1.0).alias("dur"), "p", "c")
    return _streamed(spark, rows, lambda s: stream_segments(s, late="800 seconds", idle=5000.0), "t")


def number_ranges(spark, sf_dir):
    """Decimal numbers within their ranges, from texts with signs, spaces and other things in them; and the length of a video or that it has none."""
    k = F.col("o_orderkey")
    text_ = F.concat(F.element_at(F.array(F.lit(""), F.lit(" "), F.lit("-"), F.lit("x")), (k % 4 + 1).cast("int")), F.format_string("%d.%d", k % 700, k % 10))
    log = F.when(k % 3 == 0, F.format_string("Duration: 00:%02d:01", k % 60))
    known = F.coalesce(positive(text_), clock_seconds(log)).isNotNull()
    return C.read(spark, sf_dir, "orders").select(
        "o_orderkey", valid_number(text_, 1, 600).alias("seconds"), valid_number(text_, 0.0, 1.0).alias("share"), known.alias("known"), duration(F.when(known, text_), F.when(known, log).otherwise("Duration: 0:0:0")).alias("length")
    )


def queries() -> dict:
    return {
        "hot_gap_cuts": hot_gap_cuts, "hot_enforced_gap": hot_enforced_gap, "hot_neighbours": hot_neighbours, "hot_frame_lookup": hot_frame_lookup, "hot_islands": hot_islands, "hot_cuts": hot_cuts,
        "frame_ranges": frame_ranges, "hamming_near": hamming_near, "hot_segments": hot_segments, "model_odd_frames": model_odd_frames, "export_report": export_report, "number_ranges": number_ranges, "streamed_cuts": streamed_cuts, "streamed_segments": streamed_segments, "hot_smart_pipeline": hot_smart_pipeline, "hot_adaptive_stamps": hot_adaptive_stamps, "shrunk_hist": shrunk_hist, "shrunk_prints": shrunk_prints,
    }


# ---- oracle SQL -------------------------------------------------------------------------------------------------

_HOT = "hl AS (SELECT CASE WHEN video_id % 3 = 0 THEN 0 ELSE video_id END AS video_id, event_id, t, scene FROM tl), hvid AS (SELECT DISTINCT video_id FROM hl)"
_ISLANDS = ["ab AS (SELECT event_id AS i, event_id - row_number() OVER (ORDER BY event_id) AS g FROM events WHERE value / 500 >= 0.1)", "isl AS (SELECT 0 AS video_id, min(i) AS first, max(i) AS last, (min(i) + max(i)) // 2 AS centre FROM ab GROUP BY g)"]


def _greedy(*args) -> str:
    return C._greedy(*args).replace("FROM vid", "FROM hvid")


_WIDE = """px AS (SELECT video_id, k // 40 AS y, k % 40 AS x, s AS r, 255 - s AS g, s // 2 AS b FROM (SELECT vec_id AS video_id, k, CAST(least(255, greatest(0, floor((CAST(embedding[k * 7 % 64 + 1] AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS s FROM embeddings, range(960) z(k)))"""


def _taps(name: str, n_in: int, n_out: int) -> str:
    """Weights (i, x, w) of a resize by cubic weights (a = -0.5, edges repeated, widened when shrinking)."""
    wide = max(1.0, n_in / n_out)
    return f"""{name}0 AS (SELECT i, least({n_in - 1}, greatest(0, j)) AS x, CASE WHEN d <= 1 THEN 1.5 * d ** 3 - 2.5 * d ** 2 + 1 WHEN d < 2 THEN -0.5 * d ** 3 + 2.5 * d ** 2 - 4 * d + 2 ELSE 0 END AS w
            FROM (SELECT i, j, abs(j - ((i + 0.5::DOUBLE) * {n_in} / {n_out} - 0.5)) / {wide}::DOUBLE AS d FROM range({n_out}) a(i), range(-8, {n_in + 8}) c(j))),
        {name} AS (SELECT i, x, sum(w) / any_value(t) AS w FROM {name}0 JOIN (SELECT i, sum(w) AS t FROM {name}0 GROUP BY 1) USING (i) GROUP BY 1, 2 HAVING sum(abs(w)) > 0)"""


def _low(name: str, taps: str) -> str:
    """Low frequencies (i, x, w) of 32 resized points."""
    return f"{name} AS (SELECT k AS i, x, sum(CASE WHEN k = 0 THEN sqrt(1 / 32.0::DOUBLE) ELSE sqrt(2 / 32.0::DOUBLE) END * cos((2 * i + 1) * k * pi() / 64) * w) AS w FROM {taps}, range(8) z(k) GROUP BY 1, 2)"


def _hot_plan(parts: list[str], select: str) -> str:
    """A plan's SQL over the hot timelines."""
    return "WITH RECURSIVE " + C._TL.replace("tl AS (SELECT user_id AS video_id,", "tl AS (SELECT CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS video_id,") + ", " + ", ".join(parts) + " " + select


def oracle_sql() -> dict[str, str]:
    return {
        "streamed_cuts": C.oracle_sql()["min_gap_cuts"],
        "streamed_segments": C._with(["cand AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t, p, c) AS i, t, 1.0::DOUBLE AS dur, p, c FROM tl)", C._RULE], "SELECT video_id, seg, t, dur, parts FROM segs"),
        "number_ranges": """WITH n AS (SELECT o_orderkey, o_orderkey % 4 AS kind, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN -1 END * (o_orderkey % 700 + (o_orderkey % 10) / 10.0::DOUBLE) AS x,
                CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 60 * 60 + 1 AS DOUBLE) END AS log FROM orders),
            k AS (SELECT *, (kind < 2 AND x > 0) OR log IS NOT NULL AS known FROM n)
            SELECT o_orderkey, CASE WHEN x BETWEEN 1 AND 600 THEN x END AS seconds, CASE WHEN x BETWEEN 0 AND 1 THEN x END AS share, known, CASE WHEN x > 0 THEN x WHEN known THEN log ELSE 0 END AS length FROM k""",
        "hot_smart_pipeline": _hot_plan(C._SMART, "SELECT video_id, seg, t, round(dur, 3) AS dur, parts FROM segs"),
        "hot_adaptive_stamps": _hot_plan([*C._ADAPTIVE, *C._head("merged")], "SELECT video_id, t FROM stamps"),
        "hot_gap_cuts": C._with([_HOT, "q AS (SELECT DISTINCT video_id, t FROM hl WHERE scene > 0.1)", _greedy("k", "q", 0.5, ">", True)], "SELECT video_id, t FROM k"),
        "hot_enforced_gap": C._with([_HOT, "q AS (SELECT DISTINCT video_id, t FROM hl)", _greedy("k", "q", 0.5, ">=", False), C._zero("z", "k").replace("FROM vid", "FROM hvid")], "SELECT video_id, t FROM z"),
        "hot_neighbours": C._with([_HOT, "m AS (SELECT DISTINCT video_id, t FROM hl WHERE scene > 0.5)"], """SELECT a.video_id, a.t, coalesce((SELECT max(m.t) FROM m WHERE m.video_id = a.video_id AND m.t < a.t), 0) AS previous,
            (SELECT min(m.t) FROM m WHERE m.video_id = a.video_id AND m.t > a.t) AS next FROM hl a WHERE scene <= 0.5"""),
        "hot_frame_lookup": C._with([_HOT, "w AS (SELECT video_id, event_id AS idx, greatest(0, t - 0.1) AS s FROM hl)", "f AS (SELECT video_id, t, min(event_id) AS event_id FROM hl GROUP BY 1, 2)"],
            "SELECT w.video_id, w.idx, (SELECT arg_min(event_id, t) FROM f WHERE f.video_id = w.video_id AND f.t >= w.s AND f.t < w.s + 0.2) AS frame FROM w"),
        "hot_islands": C._with(_ISLANDS, "SELECT video_id, first, last, centre FROM isl"),
        "shrunk_hist": f"""WITH {_WIDE}, {_taps("ty", 24, 16)}, {_taps("tx", 40, 16)},
            tall AS (SELECT video_id, i AS y, px.x, sum(w * r) AS r, sum(w * g) AS g, sum(w * b) AS b FROM px JOIN ty ON ty.x = px.y GROUP BY 1, 2, 3),
            small AS (SELECT video_id, y, i AS x, [sum(w * r), sum(w * g), sum(w * b)] AS rgb FROM tall JOIN tx ON tx.x = tall.x GROUP BY 1, 2, 3),
            lev AS (SELECT video_id, c AS channel, CAST(least(255, greatest(0, floor(round(rgb[c + 1], 6) + 0.5))) AS BIGINT) // 32 AS level, count(*) AS n FROM small, range(3) z(c) GROUP BY 1, 2, 3)
            SELECT CAST(v.vec_id AS VARCHAR) AS video_id, CAST(c AS BIGINT) AS channel, CAST(l AS BIGINT) AS level, CAST(coalesce(n, 0) AS BIGINT) AS n
            FROM embeddings v, range(3) a(c), range(8) d(l) LEFT JOIN lev ON lev.video_id = v.vec_id AND lev.channel = c AND lev.level = l""",
        "shrunk_prints": f"""WITH {_WIDE}, {_taps("ty", 24, 32)}, {_taps("tx", 40, 32)}, {_low("ly", "ty")}, {_low("lx", "tx")},
            tall AS (SELECT video_id, i AS u, px.x, sum(w * (0.299 * r + 0.587 * g + 0.114 * b) / 255) AS z FROM px JOIN ly ON ly.x = px.y GROUP BY 1, 2, 3),
            coef AS (SELECT video_id, u, i AS v, sum(w * z) AS z FROM tall JOIN lx ON lx.x = tall.x GROUP BY 1, 2, 3), mean AS (SELECT video_id, avg(z) AS m FROM coef GROUP BY 1)
            SELECT CAST(video_id AS VARCHAR) AS video_id, CAST(sum(CASE WHEN z > m THEN CASE WHEN u * 8 + v = 63 THEN CAST(-9223372036854775808 AS HUGEINT) ELSE CAST(CAST(1 AS BIGINT) << CAST(u * 8 + v AS INTEGER) AS HUGEINT) END ELSE 0 END) AS BIGINT) AS p
            FROM coef JOIN mean USING (video_id) GROUP BY 1""",
        "model_odd_frames": C._with([C._FRAMES], """SELECT CAST(video_id AS VARCHAR) AS video_id, i AS frame_no, CASE WHEN i % 7 <> 3 THEN round(CAST(CAST(CAST(floor(score * 250) AS FLOAT) / CAST(255 AS FLOAT) AS FLOAT) AS DOUBLE), 6) END AS score
            FROM fr, range(2) z(k) WHERE k = 0 OR i % 11 = 5"""),
        "export_report": C._with([C._SLICES], """SELECT concat('user_', video_id) AS folder, printf('Scene_%03d_%.2fs.mp4', seg, CAST(t AS DOUBLE)) AS name, CAST(round(dur, 3) AS DOUBLE) AS dur,
            CASE WHEN seg % 5 <> 4 THEN length(concat(video_id, ' ', seg)) ELSE -1 END AS bytes, CASE WHEN seg % 5 = 4 THEN 'ValueError: no data' END AS error FROM sl WHERE dur >= 0.5"""),
        "hot_segments": C._with([_HOT.replace("t, scene FROM", "t, scene, p, c FROM"), "cand AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS i, t, 1.0::DOUBLE AS dur, p, c FROM hl)", C._RULE.replace("FROM vid", "FROM hvid")],
            "SELECT video_id, seg, t, dur, parts FROM segs"),
        "hamming_near": f"""WITH {C._BITS}, b AS (SELECT vec_id * 3 + k AS id, xor(CAST(p AS BIGINT), CASE k WHEN 0 THEN CAST(0 AS BIGINT) WHEN 1 THEN CAST(21 AS BIGINT) * CAST(pow(2, vec_id % 50) AS BIGINT) ELSE CAST(31 * 256 AS BIGINT) * CAST(pow(2, vec_id % 50) AS BIGINT) END) AS p FROM h, range(3) z(k))
            SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.p, y.p)) AS BIGINT) AS distance FROM b x JOIN b y ON x.id < y.id WHERE bit_count(xor(x.p, y.p)) <= 8""",
        "frame_ranges": C._with([C._FRAMES], "SELECT video_id, i AS frame_no, CAST(floor(score * 250) AS BIGINT) AS shade FROM fr WHERE i >= 5"),
        "hot_cuts": C._with([*_ISLANDS, "s AS (SELECT video_id, CAST(centre AS DOUBLE) / 10 AS t FROM isl WHERE CAST(centre AS DOUBLE) / 10 > 0.05)", _greedy("k", "s", 0.25, ">", False)], "SELECT video_id, t FROM k"),
    }
