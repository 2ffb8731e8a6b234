"""All pairs of 64-bit hashes within a Hamming distance, by multi-index hashing.

A hash is cut into a few long blocks.  If two hashes differ in at most k bits, some block of theirs differs in few (the pigeonhole principle), so each
hash asks for its blocks and their neighbours within that radius, and hashes are stored once under each of their blocks: an equi join on long keys.

At wide distances keys are short and most pairs would meet under some key, several times over.  There all pairs are compared in tiles instead, each
pair once: quadratic, as the result then is too, but in bounded memory and over all tasks.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions.hashes import hamming
from segmill.shared import written

BITS = 64
PROBES = 800  # keys that a hash asks for, at most
HOT = 512  # distinct hashes under one key, from which on the key is split by parts of the other blocks
SHARE = 0.01  # of all pairs of unlike hashes that may meet under keys; distances at which more would are compared in tiles
TILE = 1 << 15  # hashes of a side of a tile, about
AT_ONCE = 1 << 18  # pairs of a tile that are compared at a time


def radii(distance: int, blocks: int) -> list[int]:
    """Radii of which one holds for two hashes within ``distance``: were all exceeded, the sum of differences would be above it.  -1: nothing is asked."""
    r, more = divmod(distance, blocks)
    return [r if i <= more else r - 1 for i in range(blocks)]


def cuts(blocks: int) -> list[tuple[int, int]]:
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def block_count(distance: int) -> int:
    """The least number of blocks (from three on), so the longest keys, for which a hash asks for a bounded number of them."""
    for m in range(3, BITS):
        asked = sum(comb(hi - lo, d) for (lo, hi), r in zip(cuts(m), radii(distance, m), strict=True) for d in range(r + 1))
        if asked <= PROBES:
            return m
    return BITS


def met_share(distance: int) -> float:
    """Expected meetings under keys for each pair of unlike hashes."""
    m = block_count(distance)
    return sum(comb(hi - lo, d) / 2 ** (hi - lo) for (lo, hi), r in zip(cuts(m), radii(distance, m), strict=True) for d in range(r + 1))


def others(block: int, blocks: int) -> list[tuple[int, int]]:
    """The other blocks' bits in shorter cuts, two a block where they are wide enough."""
    out = []
    for i, (lo, hi) in enumerate(cuts(blocks)):
        if i != block:
            mid = (lo + hi) // 2
            out += [(lo, mid), (mid, hi)] if hi - lo > 7 else [(lo, hi)]
    return out


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for d in range(radius + 1) for bits in combinations(range(width), d)]


def _block(h: Column, cut: tuple[int, int]) -> Column:
    lo, hi = cut
    return F.shiftrightunsigned(h, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))


def _around(h: Column, cut: tuple[int, int], radius: int, number: int) -> Column:
    """Keys (block, value) of all values within ``radius`` of a hash's block."""
    masks = F.expr(f"array({', '.join(f'{m}L' for m in _masks(cut[1] - cut[0], radius))})")  # one literal
    return F.transform(masks, lambda m: F.struct(F.lit(number).alias("block"), _block(h, cut).bitwiseXOR(m).alias("value")))


def _first(x: Column, blocks: list[tuple[int, tuple[int, int], int]]) -> Column:
    """Number of the first of some (number, cut, radius) whose block of ``x`` has no more than ``radius`` bits."""
    return reduce(lambda rest, b: F.when(F.bit_count(_block(x, b[1])) <= b[2], F.lit(b[0])).otherwise(rest), reversed(blocks), F.lit(-1))


def candidates(hashes: DataFrame, distance: int, hot: int = HOT) -> DataFrame:
    """w, ha, hb, distance of the pairs of hashes(w, h), distinct rows, that meet under a key; each pair once, ha < hb.  ``hashes`` should be stored: it is read several times.

    A key with more than ``hot`` hashes is split: within it, hashes meet under a part of the other blocks, by the same principle.
    """
    m = block_count(distance)
    every = cuts(m)
    asked = [(i, every[i], r) for i, r in enumerate(radii(distance, m)) if r >= 0]
    rest = {i: others(i, m) for i, _, _ in asked}
    within = {i: [(j, c, r) for j, (c, r) in enumerate(zip(cut, radii(distance, len(cut)), strict=True)) if r >= 0] for i, cut in rest.items()}
    h = F.col("h")

    def keys(parts: list[Column]) -> Column:
        return F.explode(F.concat(*parts) if len(parts) > 1 else parts[0])

    stored = hashes.select("w", h.alias("hb"), F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _block(h, c).alias("value")) for i, c, _ in asked])).alias("k")).select("w", "hb", "k.block", "k.value")
    asking = hashes.select("w", h.alias("ha"), keys([_around(h, c, r, i) for i, c, r in asked]).alias("k")).select("w", "ha", "k.block", "k.value")
    key = ["w", "block", "value"]
    crowded = stored.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).drop("n")
    x = F.col("ha").bitwiseXOR(F.col("hb"))
    alone = (F.col("ha") < F.col("hb")) & (_first(x, asked) == F.col("block"))
    out = ["w", "ha", "hb", hamming(F.col("ha"), F.col("hb")).cast("long").alias("distance")]
    if crowded.isEmpty():
        return asking.join(stored, key).where(alone).select(*out)
    met = asking.join(stored.join(crowded, key, "left_anti"), key).where(alone)

    def choose(of) -> Column:
        """What ``of`` gives for the row's block."""
        return reduce(lambda rest, i: F.when(F.col("block") == i, of(i)).otherwise(rest), list(within)[1:], of(next(iter(within))))

    ha, hb = F.col("ha"), F.col("hb")
    stored_twice = stored.join(crowded, key, "left_semi").withColumn("k", F.explode(choose(lambda i: F.array(*[F.struct(F.lit(j).alias("second"), _block(hb, c).alias("part")) for j, c, _ in within[i]]))))
    asking_twice = asking.join(crowded, key, "left_semi").withColumn("k", F.explode(choose(lambda i: F.concat(*[_around(ha, c, r, j) for j, c, r in within[i]]).cast("array<struct<second:int,part:bigint>>"))))
    both = [*key, "second", "part"]
    twice = asking_twice.select("ha", *key, "k.second", "k.part").join(stored_twice.select("hb", *key, "k.second", "k.part"), both)
    twice = twice.where(alone & (choose(lambda i: _first(x, within[i])) == F.col("second")))
    return met.select(*out).unionByName(twice.select(*out))


def near_in_tile(a: np.ndarray, b: np.ndarray | None, distance: int):
    """Arrays (ha, hb, distance) of the near pairs of two sides, or within one, with ha < hb, some at a time."""
    alone = b is None
    a = np.sort(a) if alone else a
    b = a if alone else b
    rows = max(1, AT_ONCE // max(1, len(b)))
    for at in range(0, len(a), rows):
        x, y = a[at : at + rows], b[at:] if alone else b
        bits = np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64))
        i, j = np.divmod(np.flatnonzero(bits <= distance), max(1, len(y)))
        if alone:
            i, j = i[j > i], j[j > i]
        if len(i):
            yield np.minimum(x[i], y[j]), np.maximum(x[i], y[j]), bits[i, j].astype(np.int64)


def tiled(hashes: DataFrame, distance: int, small: int = HOT, tile: int = TILE) -> DataFrame:
    """w, ha, hb, distance of the pairs of hashes(w, h), distinct rows, within a distance: ha < hb.  ``hashes`` should be stored: it is read several times.

    The hashes of a ``w`` are dealt into chunks of about ``tile``, and every two chunks meet in a task, which holds them and the pairs of a few rows.  Where
    a ``w`` has ``small`` hashes at most, they meet by a join.
    """
    sizes = hashes.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.ceil(F.col("n") / tile))
    few, many = hashes.join(sizes.where(F.col("n") <= small), "w").select("w", "h"), hashes.join(sizes.where(F.col("n") > small), "w")
    ha, hb = F.col("ha"), F.col("hb")
    met = few.withColumnRenamed("h", "ha").join(few.withColumnRenamed("h", "hb"), "w").where((ha < hb) & (hamming(ha, hb) <= distance))
    tiles = int(sizes.where(F.col("n") > small).agg(F.coalesce(F.sum(F.col("chunks") * (F.col("chunks") + 1) / 2), F.lit(0))).first()[0])
    parallel = hashes.sparkSession.sparkContext.defaultParallelism
    c = F.pmod(F.xxhash64("h"), F.col("chunks"))
    dealt = many.withColumn("c", c).select("w", "h", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("w", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "h")
    dealt = dealt.repartition(min(10_000, max(parallel, 4 * tiles)), "w", "i", "j").sortWithinPartitions("w", "i", "j")  # a fixed number: the rows are few for the work
    kind = hashes.schema["w"].dataType.simpleString()

    def run(batches):
        key, held = None, []

        def pairs():
            c, h = (np.concatenate(p) for p in zip(*held, strict=True))
            w, i, j = key
            for a, b, d in near_in_tile(h[c == i], None if i == j else h[c == j], distance):
                yield pa.RecordBatch.from_arrays([pa.repeat(w, len(a)), pa.array(a), pa.array(b), pa.array(d)], ["w", "ha", "hb", "distance"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            w, (i, j, c, h) = batch.column(0), (batch.column(k).to_numpy() for k in range(1, 5))
            new = np.flatnonzero(pc.not_equal(w[1:], w[:-1]).to_numpy(zero_copy_only=False) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for at, end in zip([0, *new], [*new, n], strict=True):
                now = (w[at], i[at], j[at])
                if key is not None and now != key:
                    yield from pairs()
                    held = []
                key = now
                held.append((c[at:end], h[at:end]))
        if held:
            yield from pairs()

    return met.select("w", "ha", "hb", hamming(ha, hb).cast("long").alias("distance")).unionByName(dealt.mapInArrow(run, f"w {kind}, ha long, hb long, distance long"))


def linked_hashes(rows: DataFrame, hash_col: str, distance: int, within: str | None = None, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Classes (w, h, n: the distinct hashes and their rows' number) and links (w, ha, hb, distance) between classes within a distance.

    Copies meet in their class before the shuffle and are not expanded into pairs.  Rows without a hash (or ``within``) are in no class.
    """
    usable = rows.where(F.col(hash_col).isNotNull()).select((F.col(within) if within else F.lit(0)).alias("w"), F.col(hash_col).cast("long").alias("h")).where("w is not null")
    classes = written(usable.groupBy("w", "h").agg(F.count(F.lit(1)).alias("n")), "hash-classes")
    near = tiled if met_share(distance) > SHARE else candidates
    return classes, near(classes.select("w", "h"), distance, hot).where(F.col("distance") <= distance)


def pairs_within(rows: DataFrame, id_col: str, hash_col: str, distance: int, within: str | None = None, hot: int = HOT) -> DataFrame:
    """a, b, distance of all pairs of rows (of equal ``within``, if given) whose 64-bit hashes differ in ``distance`` bits at most, a < b.

    All pairs of copies are among them, so the result grows with the square of a class; :func:`linked_hashes` gives the same links by classes.
    """
    stored = written(rows.where(F.col(hash_col).isNotNull()).select((F.col(within) if within else F.lit(0)).alias("w"), F.col(id_col).alias("id"), F.col(hash_col).cast("long").alias("h")), "hashes")
    classes, links = linked_hashes(stored, "h", distance, "w", hot)
    links = links.unionByName(classes.where("n > 1").select("w", F.col("h").alias("ha"), F.col("h").alias("hb"), F.lit(0).cast("long").alias("distance")))
    left, right = stored.select("w", F.col("id").alias("x"), F.col("h").alias("ha")), stored.select("w", F.col("id").alias("y"), F.col("h").alias("hb"))
    met = links.join(left, ["w", "ha"]).join(right, ["w", "hb"]).where((F.col("x") < F.col("y")) | ((F.col("ha") != F.col("hb")) & (F.col("x") > F.col("y"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
