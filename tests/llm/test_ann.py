import numpy as np
from pyspark.sql import functions as F

from segmill.llm.ann import cosines, nearest, quantise, tile_nearest


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = []
    for q, a in ok:
        if q % every == 0:
            near = sorted((-float(cosines(a[None], b[None])[0]), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def make():
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(16) + (i % 5))], "c") for i in range(300)]
    rows += [(300 + i, rows[10][1], "c") for i in range(12)]  # ties
    rows += [(400, None, "c"), (410, [0.0] * 16, "c"), (420, [float("nan")] + [1.0] * 15, "c"), (430, [None] + [1.0] * 15, "c"), (440, [1e-30] * 16, "c"), (450, [1.0, 2.0], "c"), (460, [2.0, 1.0], "c"), (470, [], "c"), (480, [1.0, 2.0, 3.0], "c"), (None, [1.0] * 16, "c")]
    return rows


def test_same_as_brute_force(spark):
    rows = make()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, _ in rows], 5, 10)
    for blocks in ({}, {"query_block": 7, "row_block": 50}):
        assert sorted(map(tuple, nearest(df, F.col("vec_id") % 10 == 0, **blocks).collect())) == want
    assert nearest(df.where("vec_id < 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    q, x = rng.standard_normal((40, 64)), rng.standard_normal((3000, 64))
    qc, qs, qn, qe = quantise(q)
    xc, xs, xn, xe = quantise(x)
    true = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    mid = (qc.astype(int) @ xc.astype(int).T) * (qs[:, None] * xs)
    slack = qn[:, None] * xe + qe[:, None] * (xn + xe)
    assert (np.abs(true - mid) <= slack + 1e-12).all() and slack.max() < 0.05
    got = tile_nearest(np.arange(40), q, np.arange(100, 3100), x, 5)
    assert {(a, b) for a, b, _ in got} == {(i, 100 + j) for i in range(40) for j in np.argsort(-true[i])[:5].tolist()}


def test_repeated_rows(spark):
    rows = [(10, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [1.0, 1.0]), (11, [1.0, 1.0]), (12, [0.0, 1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(10, 1, 11), (10, 2, 11)]


def test_extreme_magnitudes_and_queries_asked_twice(spark):
    rows = [(10, [1e200, 2e200]), (10, [1e200, 2e200]), (11, [3e-200, 6e-200]), (12, [1e300, 0.0]), (13, [1e-300, 1e-300]), (14, [5e-324, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=4).collect()
    assert [r.rank for r in sorted(got, key=lambda r: r.rank)] == [1, 2, 3, 4] and {r.vec_id for r in got if r.rank > 2} == {12, 14}
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)][:2] == [11, 13]
    assert np.allclose([r.score for r in sorted(got, key=lambda r: r.rank)], [1, 3 / 10**0.5, 1 / 5**0.5, 1 / 5**0.5])
