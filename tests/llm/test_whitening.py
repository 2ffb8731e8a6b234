import math
import random

import numpy as np
import pytest

from segmill.llm.whitening import Moments, Whitener, eigen, exact_sums, local_moments, op12, whiten

SCHEMA = "vec_id long, embedding array<float>, n long, component string"


def brute(vectors):
    """n, deviations and covariance of distinct integer vectors, in exact arithmetic."""
    xs = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    distinct = sorted(set(xs))
    n, d = len(distinct), len(distinct[0])
    s = [sum(x[j] for x in distinct) for j in range(d)]
    off = [[n * x[j] - s[j] for j in range(d)] for x in distinct]
    cov = np.array([[sum(o[i] * o[j] for o in off) / n**3 for j in range(d)] for i in range(d)])
    return xs, n, s, [sum((n * x[j] - s[j]) ** 2 for j in range(d)) for x in xs], cov


def check(got, ids, vectors, components):
    xs, n, s, deviations, cov = brute(vectors)
    d = len(s)
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    assert len(got) == len(vectors) * components
    rows = {(r.vec_id, r.component): r for r in got}
    signs = {}
    for i, x, dev in zip(ids, xs, deviations, strict=True):
        exact = np.array([(n * x[j] - s[j]) / n for j in range(d)])
        for c in range(1, components + 1):
            r = rows[i, c]
            assert (r.n, r.deviation) == (n, dev)
            want = exact @ vecs[:, c - 1] / math.sqrt(values[c - 1])
            sign = signs.setdefault(c, 1 if abs(r.whitened - want) <= abs(r.whitened + want) else -1) if abs(want) > 1e-3 else signs.get(c, 1)
            assert r.whitened * sign == pytest.approx(want, abs=1e-7)
            assert r.explained == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9)
            assert 0 <= r.identity_error < 1e-9


def test_brute_force(spark):
    rnd = np.random.default_rng(3)
    vectors = (rnd.normal(size=(300, 20)) * np.linspace(1, 5, 20) @ rnd.normal(size=(20, 20)) + 100).astype(np.float32).tolist()
    vectors += [vectors[0]] * 40 + [[v + 1e-5 for v in vectors[1]]]  # copies, and one that floors to the same integers
    rows = [(i, v, 7, "c") for i, v in enumerate(vectors)]
    got = op12(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    check(got, range(len(vectors)), [np.float32(v).astype(float).tolist() for v in vectors], 16)


def test_edges(spark):
    rnd = random.Random(1)
    good = [[rnd.uniform(-3, 3) for _ in range(3)] for _ in range(30)]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [3e37, 0.0, 0.0]]
    rows = [(i, v, 0, "x") for i, v in enumerate(good)] + [(1000 + i, v, 0, "x") for i, v in enumerate(bad)] + [(5, good[5], 0, "x")]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 31 * 3 and {r.vec_id for r in got} == set(range(30)) and {r.n for r in got} == {30}
    null_id = whiten(spark.createDataFrame([*rows, (None, good[0], 0, "x")], SCHEMA)).where("vec_id is null").collect()
    assert len(null_id) == 3
    doubles = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(good)], "id long, v array<double>")
    check(whiten(doubles, "id", "v", 2).collect(), range(30), good, 2)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None, 0, "x")], [(1, [1.0, 2.0], 0, "x"), (2, [1.0, 2.0], 0, "x")]):
        out = op12(spark.createDataFrame(rows, SCHEMA))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_flat_directions_are_left_out(spark):
    rows = [(i, [float(i), float(i), 5.0], 0, "x") for i in range(10)]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 10 and got[0].explained == pytest.approx(1)


def test_merged_moments_are_those_of_the_whole():
    rnd = np.random.default_rng(8)
    x = rnd.integers(-1000, 1000, (500, 6)) + 2**60
    whole, parts = local_moments(x), [local_moments(p) for p in np.split(x, [1, 7, 200])]
    merged = parts[0].merge(parts[1]).merge(parts[2].merge(parts[3]))
    assert (merged.n, merged.total) == (500, [int(sum(c.tolist())) for c in x.T]) and whole.total == exact_sums(x)
    exact = np.cov((x - 2**60).T, bias=True) * 500
    assert np.allclose(merged.scatter, exact, rtol=1e-12, atol=1e-6) and np.allclose(whole.scatter, exact, rtol=1e-12, atol=1e-6)


def test_deviation_beyond_long_is_null():
    x = np.array([[0, 0], [3, 1], [2**40, 0]], np.int64)
    n, total = 2**20, [2**19, 5]
    got = Whitener(n, total, np.eye(2), np.ones(2), np.ones(2)).deviations(x).to_pylist()
    want = [sum((n * int(v) - t) ** 2 for v, t in zip(r, total, strict=True)) for r in x]
    assert got == [want[0], want[1], None] and want[2] > 2**63


def test_eigen_of_a_single_vector_has_no_components():
    assert len(eigen(Moments(1, [5, 6], np.zeros((2, 2))), 16).values) == 0
