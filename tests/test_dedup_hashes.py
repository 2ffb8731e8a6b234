import io
import random

import numpy as np
from pyspark.sql import functions as F

from segmill.functions import hashes, images
from segmill.operators.dedup import Accepted, long_merge_drop_new, merge_drop_new
from segmill.operators.similar import pairs_within
from segmill.operators.model import detect, frame_scores, tensor, windows_of
from segmill.sources.frames import RawFrameSource
from segmill.sources.tables import raw_frames, read_exact, split_frames

M = 2**64 - 1


def rule(cands):
    done, seen, cur, lp, lc = [], [], False, 0, 0
    ham = lambda a, b: ((a ^ b) & M).bit_count()
    for t, d, p, c in cands:
        if p is None or c is None:
            continue
        if cur and ham(p, lp) <= 3 and ham(c, lc) <= 2:
            done[-1] = (done[-1][0], done[-1][1] + d, done[-1][2] + 1)
        elif any(ham(p, a) <= 5 and ham(c, b) <= 3 for a, b in seen):
            cur = False
        else:
            done.append((t, d, 1))
            seen.append((p, c))
            cur, lp, lc = True, p, c
    return done


def bits(n):
    return (1 << n) - 1


def run(spark, lists):
    kind = "i int, x array<struct<t: double, dur: double, p: bigint, c: bigint>>"
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], kind)
    return {r.i: [tuple(y) for y in r.y] for r in df.select("i", merge_drop_new(F.col("x")).alias("y")).collect()}


def test_consequences(spark):
    a = (0.0, 1.0, 0, 0)
    lists = [
        [a, (1.0, 2.0, bits(3), bits(2))],  # inclusive: merged
        [a, (1.0, 2.0, bits(4), bits(2))],  # near miss to the open one: dropped
        [a, (1.0, 2.0, bits(4), bits(2)), (3.0, 1.0, 0, 0)],  # a repeat after a drop is dropped
        [a, (1.0, 2.0, bits(6), 0), (3.0, 1.0, 0, bits(4))],  # just beyond: new
        [(0.0, 1.0, None, None), a, (5.0, 1.0, None, 0), (6.0, 1.0, 0, 0)],  # without hashes nothing changes
        [],
    ]
    got = run(spark, lists)
    assert [len(got[i]) for i in range(6)] == [1, 1, 1, 3, 1, 0]
    assert got[0] == [(0.0, 3.0, 2)] and got[4] == [(0.0, 2.0, 2)]


def test_random_sequences(spark):
    rnd = random.Random(8)
    lists = [[(float(i), 1.0, *(None if rnd.random() < 0.1 else bits(rnd.randrange(12)) - (2**63 if rnd.random() < 0.3 else 0) for _ in range(1)), bits(rnd.randrange(5))) for i in range(rnd.randint(0, 25))] for _ in range(200)]
    got = run(spark, lists)
    assert all(got[i] == rule(x) for i, x in enumerate(lists))


def test_pairs_within(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(20)]
    vals = [b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 8))) & M for b in base for _ in range(6)]
    rows = [(i, v - (1 << 64) if v >> 63 else v, i % 3) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "id long, h long, g int")
    for within in (None, "g"):
        want = sorted((i, j, (vals[i] ^ vals[j]).bit_count()) for i in range(len(vals)) for j in range(i + 1, len(vals)) if (vals[i] ^ vals[j]).bit_count() <= 5 and (not within or i % 3 == j % 3))
        assert sorted(map(tuple, pairs_within(df, "id", "h", 5, within).collect())) == want


def gradient(n):
    shade = (255 * np.arange(n) // (n - 1)).astype(np.uint8)
    return np.repeat(np.stack([shade, 255 - shade, shade // 2], axis=1)[:, None], n, axis=1)


def test_picture_hashes():
    g = gradient(64)
    assert images.picture_hash(g) == images.picture_hash(g) != 0
    assert abs(images.normalised_histogram(gradient(32)).sum() - 1) < 1e-3 and images.histogram(gradient(32)).sum() == 768
    x = np.random.default_rng(0).random((32, 32))
    direct = np.array([[sum(x[a, b] * np.cos((2 * a + 1) * u * np.pi / 64) * np.cos((2 * b + 1) * v * np.pi / 64) for a in range(32) for b in range(32)) for v in range(2)] for u in range(2)])
    scale = np.array([np.sqrt(1 / 32), np.sqrt(2 / 32)])
    assert np.allclose(images.dct_low(x)[:2, :2], direct * np.outer(scale, scale))
    assert np.allclose(images.resize(np.full((40, 30), 7.0), 16, 16), 7)


def test_fingerprints_match_columns(spark):
    rng = np.random.default_rng(1)
    pics = [gradient(48), rng.integers(0, 256, (20, 30, 3), dtype=np.uint8)]
    rows = [("v", i, p.shape[0], p.shape[1], "rgb24", p.tobytes()) for i, p in enumerate(pics)]
    rows.append(("v", 2, 48, 48, "bgra", np.concatenate([pics[0][..., ::-1], np.zeros((48, 48, 1), np.uint8)], axis=2).tobytes()))
    rows += [("v", 3, 4, 4, "rgb24", None), ("v", 4, 400, 400, "rgb24", b"abc")]
    got = {r.idx: r for r in images.fingerprints(spark.createDataFrame(rows, "video_id string, idx int, height int, width int, mode string, data binary")).collect()}
    assert [got[i].p & M for i in (0, 1)] == [images.picture_hash(p) for p in pics] and got[2][2:] == got[0][2:]
    assert got[3].p is None and got[4].c is None
    counts = [images.histogram(p).tolist() for p in pics]
    cols = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "i int, n array<int>").select("i", hashes.channel_bits(F.col("n")).alias("c")).collect()
    assert [r.c for r in sorted(cols)] == [got[i].c for i in (0, 1)]


def test_mean_bits(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(30)]
    got = spark.createDataFrame(rows, "i int, v array<double>").select("i", hashes.mean_bits(F.col("v")).alias("h")).collect()
    assert [r.h & M for r in sorted(got)] == [images.bits_over_mean(np.array(v)) for _, v in rows]


def test_model_seam(spark, tmp_path):
    def frame(v):
        return bytes([v]) * (27 * 48 * 3)

    assert tensor([frame(255)] * 3).shape == (1, 100, 27, 48, 3) and tensor([frame(255)]).max() == 1
    for shape in ((1, 100, 2), (1, 100), (100, 2), (100,)):
        x = np.arange(np.prod(shape)).reshape(shape)
        assert len(frame_scores(x, 40)) == 40
    assert [len(w) for w in windows_of(iter([b""] * 250))] == [100, 100, 50]
    data = [frame(250 if i in (30, 31, 140) else 0) for i in range(160)]
    (tmp_path / "a.rgb").write_bytes(b"".join(data) + b"part")
    assert len(list(split_frames(io.BytesIO(b"abcdefgh"), 3))) == 2 and read_exact(io.BytesIO(b"ab"), 5) == b"ab"
    frames = raw_frames(spark, str(tmp_path), 48, 27)
    cuts = detect(frames, lambda: lambda x: x.mean(axis=(2, 3, 4))[..., None], 0.5, 10.0)
    assert sorted(r.t for r in cuts.collect()) == [3.0, 14.0]
    spark.dataSource.register(RawFrameSource)
    own = spark.read.format("rawframes").options(path=str(tmp_path / "a.rgb"), width="48", height="27").load()
    assert own.count() == 160 and own.where("frame_no = 30").first().rgb == data[30]


def test_long_timelines_have_an_index_of_hashes(spark):
    rnd = random.Random(11)
    lists = {}
    for v in range(6):
        p, c = 0, 0
        lists[v] = []
        for i in range(400):
            if rnd.random() < 0.5:
                p, c = rnd.choice([rnd.getrandbits(64), bits(rnd.randrange(64)), p]), rnd.choice([rnd.getrandbits(24), bits(rnd.randrange(24)), c])
            if rnd.random() < 0.2 and lists[v]:
                p, c = rnd.choice(lists[v])[2:]
            flip = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6)))
            lists[v].append((float(i), 1.5, p ^ flip, c ^ sum(1 << b for b in rnd.sample(range(24), rnd.randint(0, 4)))))
    rows = [(v, t, d, p - (1 << 64) if p >> 63 else p, c) for v, x in lists.items() for t, d, p, c in x] + [(2, 3.5, 1.0, None, 4), (9, 1.0, 1.0, None, None)]
    rnd.shuffle(rows)
    got = {}
    for r in long_merge_drop_new(spark.createDataFrame(rows, "video_id int, t double, dur double, p long, c long")).orderBy("video_id", "seg").collect():
        got.setdefault(r.video_id, []).append((r.t, r.dur, r.parts))
    assert got == {v: rule(x) for v, x in lists.items()}
    assert long_merge_drop_new(spark.createDataFrame([], "video_id int, t double, dur double, p long, c long")).count() == 0


def test_index_is_near_linear():
    """All of 30,000 unlike hashes are accepted; each looks at few others."""
    rnd, index = random.Random(3), Accepted()
    for _ in range(30_000):
        p, c = rnd.getrandbits(64), rnd.getrandbits(24)
        if not index.repeats(p, c):
            index.add(p, c)
    lists = list(index._under.values())
    assert sum(map(len, lists)) == 24 * 30_000 and sum(len(x) ** 2 for x in lists) / 30_000 < 60
