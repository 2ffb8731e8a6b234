"""Connected components of an edge table, as rounds of star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    """Points each node's larger (or smaller) neighbours at the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-least")
    near = both.join(least, "a")
    if large:
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = scratch.write(out.where("a <> b").distinct(), name)
    scratch.drop(f"{name}-least")
    return out


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``node``, ``component`` (least node reachable) for every node of ``edges(a, b)``, any order, repeats allowed.

    Large-star and small-star rounds alternate until no edge changes, which takes about log(n) rounds; nothing but two
    totals per round reaches the driver.  The least neighbours go through a table, so both sides of each join are plain
    exchanges and a node with very many edges is split by the adaptive skew join.
    """
    cur = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before, i = None, 0
    while True:
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before, i = now, i + 1
        lifted = _star(cur, scratch, f"{name}-{i}l", True)
        nxt = _star(lifted, scratch, f"{name}-{i}", False)
        scratch.drop(f"{name}-{i}l", f"{name}-{i - 1}")
        cur = nxt
    roots = cur.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
