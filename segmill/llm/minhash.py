"""Near-duplicate groups: SuperMinHash signatures, banding, links confirmed on full shingle sets, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _C, Scratch, in_chunks, mix64, shingle_sets, trimmed, trimmed_group, whole_text
from .components import components

BANDS, ROWS = 32, 5  # a pair of similarity 0.8 misses every band with probability 3e-6
TILE = 1024  # documents in a block of a residual bucket

_U = np.uint64


def super_minhash(elems: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` unsigned integers per set.

    Every element draws a random permutation of the ``m`` positions and gives the position of rank ``j`` the value
    ``j`` + a random fraction; a position keeps the least value.  The ranks of one element differ, which is what lowers the
    variance below that of independent hashes.  All elements of all sets advance one rank at a time (each by one step
    of its Fisher-Yates shuffle), and a set leaves as soon as no position can still fall, which for sets much larger than
    ``m`` is after one or two ranks.  Values are rank << 32 | fraction.
    """
    d = len(sizes)
    sig = np.full(d * m, _U(2**64 - 1), np.uint64)
    owner = np.repeat(np.arange(d), sizes)
    perm = None
    for j in range(m):
        if not len(elems):
            break
        bits = mix64(elems + _U(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
        k = j + ((bits >> _U(32)) * _U(m - j) >> _U(32)).astype(np.int64)
        value = (bits & _U(0xFFFFFFFF)) | _U(j << 32)
        if j == 0:
            position = k
        else:
            rows = np.arange(len(elems))
            position = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, owner * m + position, value)
        open_sets = sig.reshape(d, m).max(axis=1) >= _U((j + 1) << 32)
        stay = open_sets[owner]
        if j == 0:
            elems, owner, k = elems[stay], owner[stay], k[stay]
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(elems), 1))
            perm[np.arange(len(elems)), k] = 0
        elif not stay.all():
            elems, owner, perm = elems[stay], owner[stay], perm[stay]
    return sig.reshape(d, m)


def _sketch(k: int, bands: int, rows: int):
    def run(batches):
        for whole in batches:
            for b in in_chunks(whole, "text", 800_000):
                texts = b.column("text").cast("binary").to_pylist()
                elems, sizes = shingle_sets(texts, k)
                sig = super_minhash(elems, sizes, bands * rows)
                salts = mix64(np.arange(1, bands + 1, dtype=np.uint64))
                keys = mix64((sig.reshape(len(texts), bands, rows) * _C[:rows]).sum(axis=2, dtype=np.uint64) ^ salts)
                at = np.concatenate([[0], np.cumsum(sizes)])
                prints = []
                for c in (_C[40], _C[41]):
                    run_sum = np.concatenate([[_U(0)], np.cumsum(mix64(elems * c))])
                    prints.append((run_sum[at[1:]] - run_sum[at[:-1]]).view(np.int64))
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(sizes), pa.array(prints[0]), pa.array(prints[1]), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))],
                    ["doc_id", "n", "f1", "f2", "keys"],
                )

    return run


def _full_sets(k: int):
    def run(batches):
        for whole in batches:
            for b in in_chunks(whole, "text"):
                elems, sizes = shingle_sets(b.column("text").cast("binary").to_pylist(), k)
                at = np.concatenate([[0], np.cumsum(sizes)])
                blobs = [elems[at[i] : at[i + 1]].tobytes() for i in range(len(sizes))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(blobs, pa.binary())], ["doc_id", "shingles"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for two sorted arrays of distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            x, y = (b.column(c).to_pylist() for c in ("sa", "sb"))
            keep = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tile_links(percent: int):
    """Links between two blocks of a bucket, as a spanning forest over the components that the rows bring along."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf.i.iloc[0] == pdf.j.iloc[0]
        rows_of = pdf.sort_values("side", kind="stable")
        n = len(pdf) if same else int((pdf.side == 0).sum())
        second = slice(0, n) if same else slice(n, None)
        sets = [np.frombuffer(s, np.uint64) for s in rows_of.shingles]
        ids, comp = rows_of.doc_id.to_numpy(), rows_of.component.to_numpy()
        sizes = np.array([len(s) for s in sets])
        cols = np.unique(np.concatenate(sets), return_inverse=True)[1]
        keep = (np.bincount(cols) > 1)[cols]
        rows, (shared, cols) = np.repeat(np.arange(len(sets)), sizes)[keep], np.unique(cols[keep], return_inverse=True)
        common = np.zeros((n, len(sizes[second])), np.float32)
        for c in range(0, len(shared), 2048):
            inside = (cols >= c) & (cols < c + 2048)
            m = np.zeros((len(sets), min(2048, len(shared) - c)), np.float32)
            m[rows[inside], cols[inside] - c] = 1
            common += m[:n] @ m[second].T
        linked = 100 * common >= percent * (sizes[:n, None] + sizes[None, second] - common)
        linked &= comp[:n, None] != comp[None, second]
        root = {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            p, q = find(int(comp[i])), find(int(comp[second][j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((ids[i], ids[second][j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable over links), kept.

    Two documents are linked when their sets of ``shingle``-word shingles (A-Z in lower case; words split at space and
    0x09-0x0D) have 100 * intersection >= ``percent`` * union.  The steps:

    1. Each document gives its set's size, 128-bit fingerprint and ``bands`` band keys of its SuperMinHash signature.
    2. Documents with equal fingerprints form a class, which its least id stands for from here on, so copies cost nothing.
    3. In each band bucket the least class is the pivot; every other member is paired with it, never with all the others.
       Pairs are confirmed on full sets and joined into components.
    4. Buckets whose members still lie in several components are the rest: their members are compared block by block
       (full sets, a matrix product a block pair), and only links that join two components come out.  So every pair
       that shares a bucket is linked, known to be connected, or refuted, with no cap on a bucket.
    5. Components are taken over all links and handed back to classes and documents.

    A document with fewer words than ``shingle`` has its whole sequence as its one shingle.  Null or wordless text has no shingle, is linked
    with nothing and stays.  A row that repeats an id and its text gives one more equal row.  An id that stands with several texts is one node: a link of one
    of its texts is a link of that id.  A row without an id is never kept and
    links nothing.  Very long texts are taken whole; ties do not occur, as ids are ordered.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    base = whole_text(docs, id_col, text_col)
    sketch = base.mapInArrow(trimmed(_sketch(shingle, bands, rows)), "doc_id long, n long, f1 long, f2 long, keys array<long>")
    sketch = scratch.write(sketch, "sketch")
    classes = scratch.write(sketch.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")), "classes")
    reps = sketch.select("doc_id", "n", "keys").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    banded = reps.select("doc_id", "n", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot < last").select("key", "pivot")
    buckets = scratch.write(buckets, "buckets")
    members = scratch.write(banded.join(buckets, "key"), "members")

    wanted = members.select("doc_id").distinct()
    sets = scratch.write(base.join(wanted, "doc_id", "left_semi").mapInArrow(trimmed(_full_sets(shingle)), "doc_id long, shingles binary"), "sets")
    pairs = members.where("doc_id <> pivot").select("doc_id", "pivot", "n").distinct()
    sized = pairs.join(members.select(F.col("doc_id").alias("pivot"), F.col("n").alias("m")).distinct(), "pivot")
    sized = sized.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    sized = scratch.write(sized, "pairs")

    def side(name: str, blob: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(blob))

    links = sized.join(side("a", "sa"), "a").join(side("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(trimmed(_confirm(percent)), "a long, b long")
    links = scratch.write(links, "links")
    first = scratch.write(components(links, scratch, "first"), "first")

    known = members.select("key", "doc_id").join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    known = scratch.write(known, "known")
    seen = F.xxhash64("doc_id").cast("decimal(38,0)")
    open_ = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum(seen).alias("print")).where("lo < hi")
    open_ = scratch.write(open_.groupBy("size", "print").agg(F.min("key").alias("key")), "open")  # buckets with the same members count once
    if not open_.isEmpty():
        blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / TILE)).cast("int")
        rest = known.join(open_, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        here = F.struct(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        rest = rest.select("key", here.alias("t"), "doc_id", "component", (F.col("own") > F.col("other")).cast("int").alias("side"))
        rest = rest.select("key", "t.i", "t.j", "doc_id", "component", "side").join(sets, "doc_id")
        more = rest.groupBy("key", "i", "j").applyInPandas(trimmed_group(_tile_links(percent)), "a long, b long").distinct()
        links = scratch.write(links.unionByName(more), "all_links")
        first = scratch.write(components(links, scratch, "second"), "second")
    scratch.drop("sets", "members", "known", "buckets", "pairs")

    grouped = classes.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    grouped = scratch.write(grouped, "grouped")
    own = sketch.select("doc_id", "n", "f1", "f2")
    found = own.where("n > 0").join(grouped, ["f1", "f2"]).unionByName(own.where("n = 0").withColumn("component_id", F.col("doc_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
