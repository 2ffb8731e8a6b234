"""Multi-index hashing against all pairs, with hot keys, copies and a count of candidates."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.operators.similar import block_count, candidates, cuts, linked_hashes, met_share, near_in_tile, others, pairs_within, radii, tiled


def signed(v):
    v &= 2**64 - 1
    return v - (1 << 64) if v >> 63 else v


def distance(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def flipped(rnd, v, n):
    for b in rnd.sample(range(64), n):
        v ^= 1 << b
    return v


@pytest.mark.parametrize("k", [0, 1, 3, 5, 6, 8, 12, 20, 40, 63])
def test_some_block_is_within_its_radius(k):
    m, rnd = block_count(k), random.Random(k)
    for cut in (cuts(m), others(0, m), others(m - 1, m)):
        for _ in range(2000):
            x = flipped(rnd, 0, rnd.randint(0, k))
            assert any((x >> lo & (1 << hi - lo) - 1).bit_count() <= r for (lo, hi), r in zip(cut, radii(k, len(cut)), strict=True))


@pytest.mark.parametrize(("k", "hot"), [(0, 512), (3, 512), (5, 2), (6, 512), (8, 3), (8, 512), (20, 4)])
def test_all_pairs(spark, k, hot):
    rnd = random.Random(k + hot)
    base = [rnd.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    values = [signed(flipped(rnd, b, rnd.randint(0, 9))) for b in base for _ in range(8)] + [signed(base[0])] * 3
    rows = [(i, v, i % 3 if i % 17 else None) for i, v in enumerate(values)] + [(10_000, None, 1)]
    df = spark.createDataFrame(rows, "id long, h long, w int")
    for within in (None, "w"):
        want = sorted((i, j, distance(values[i], values[j])) for i in range(len(values)) for j in range(i + 1, len(values)) if distance(values[i], values[j]) <= k and (not within or (rows[i][2] is not None and rows[i][2] == rows[j][2])))
        assert sorted(map(tuple, pairs_within(df, "id", "h", k, within, hot).collect())) == want


@pytest.mark.parametrize("k", [3, 8])
def test_few_candidates(spark, k):
    """Of 4,000 hashes in near pairs and as many without, the pairs looked at are at most ten times those found."""
    rnd = random.Random(1)
    values = [rnd.getrandbits(64) for _ in range(6000)]
    values += [flipped(rnd, v, rnd.randint(1, k)) for v in values[:2000]]
    hashes = spark.createDataFrame([(0, signed(v)) for v in set(values)], "w int, h long").repartition(4)
    met = candidates(hashes, k)
    looked, found = met.count(), met.where(F.col("distance") <= k).count()
    assert found >= 2000 and looked <= 10 * found


def test_classes_of_copies(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 5).when(F.col("id") < 2900, 7).otherwise(F.col("id") * 1_000_003_000_017).alias("h"))
    classes, links = linked_hashes(rows, "h", 3)
    assert {(r.h, r.n) for r in classes.where("n > 1").collect()} == {(5, 2000), (7, 900)}
    assert (0, 5, 7, 1) in {tuple(r) for r in links.collect()}


def test_empty(spark):
    assert pairs_within(spark.createDataFrame([], "id long, h long"), "id", "h", 5).count() == 0


def test_wide_distances_compare_each_pair_once(spark):
    """Under the keys of distance 20 over half of all pairs would meet."""
    assert met_share(8) < 0.001 and met_share(20) > 0.5
    rnd = random.Random(2)
    values = [signed(flipped(rnd, v, rnd.randint(0, 14))) for v in [rnd.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1] for _ in range(20)]
    rows = sorted({(f"w{i % 40 % 3}" if i % 9 else f"x{i % 50}", v) for i, v in enumerate(values)})
    hashes = spark.createDataFrame(rows, "w string, h long").repartition(3)
    want = sorted((w, a, b, distance(a, b)) for w, a in rows for v, b in rows if w == v and a < b and distance(a, b) <= 20)
    for small, tile in ((0, 7), (5, 50), (0, 1 << 15), (1000, 7)):
        assert sorted(map(tuple, tiled(hashes, 20, small, tile).collect())) == want
    met = linked_hashes(hashes, "h", 20, "w", hot=5)[1]
    assert "MapInArrow" in met._jdf.queryExecution().toString() and sorted(map(tuple, met.collect())) == want


def test_pairs_of_a_tile_come_a_few_at_a_time():
    """All of 3,000 hashes are near each other: no step gives more than the pairs that are compared at a time."""
    a = np.arange(3000, dtype=np.int64)
    got = [len(x) for x, _, _ in near_in_tile(a, None, 20)]
    assert sum(got) == 3000 * 2999 // 2 and max(got) <= 1 << 18
