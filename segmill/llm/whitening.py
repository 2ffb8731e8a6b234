"""Embedding whitening: moments merged by Chan's formula in a tree, eigenvectors on the driver, a second pass that verifies."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, trimmed

SCALE = 64  # an entry c stands for the integer floor(SCALE * c) + OFFSET
OFFSET = 1_000_000
COMPONENTS = 16
LARGEST = 2.0**62  # scaled entries from here on are no 64-bit integers with room for differences
DEPTH = 4  # of the tree of merges: the driver gets about the fourth root of the number of partitions
LONG = 2**63 - 1


# ---- moments ----------------------------------------------------------------------------------------------------


@dataclass
class Moments:
    """Count, sums and centred scatter of some vectors.  Sums of integers are exact, whatever their size."""

    n: int
    total: list
    scatter: np.ndarray

    def merge(self, other: Moments) -> Moments:
        """Chan's formula: scatters add up, plus the outer product of the means' difference, weighted by both counts."""
        n = self.n + other.n
        apart = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.total, other.total, strict=True)])
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * (other.n / n))
        return Moments(n, [a + b for a, b in zip(self.total, other.total, strict=True)], scatter)


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of each column of 64-bit integers as Python integers: upper and lower halves are summed apart."""
    high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
    return [(h << 32) + w for h, w in zip(high, low, strict=True)]


def centred(x: np.ndarray, n: int, total: list) -> np.ndarray:
    """Rows minus the mean ``total / n`` as doubles.  Of integers the mean's whole part is taken off before anything is rounded."""
    if x.dtype != np.int64:
        return x - np.array(total) / n
    whole = np.array([t // n for t in total], np.int64)
    return (x - whole) - np.array([(t % n) / n for t in total])


def local_moments(x: np.ndarray) -> Moments:
    total = exact_sums(x) if x.dtype == np.int64 else x.sum(axis=0).tolist()
    c = centred(x, len(x), total)
    return Moments(len(x), total, c.T @ c)


def moments(df: DataFrame, rows_of: Callable[[pa.RecordBatch], np.ndarray]) -> Moments | None:
    """Moments over all rows: one value per partition, merged pairwise in a tree.  None without rows."""

    def run(batches):
        state = None
        for b in batches:
            x = rows_of(b)
            if len(x):
                part = local_moments(x)
                state = state.merge(part) if state else part
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    def merge(a: Moments | None, b: Moments | None) -> Moments | None:
        return a.merge(b) if a and b else a or b

    states = df.mapInArrow(trimmed(run), "state binary").rdd.map(lambda r: pickle.loads(r.state))
    return states.treeAggregate(None, merge, merge, DEPTH)


# ---- vectors as integers ----------------------------------------------------------------------------------------


def integer_rows(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and integers of the usable vectors of an Arrow array of lists, by length.

    Usable are vectors with at least one entry, all of them finite and in range (:data:`LARGEST`).
    """
    lens = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes NaN
    ends = np.cumsum(lens)
    scaled = flat * SCALE
    bad = np.concatenate([[0], np.cumsum(~(np.abs(scaled) < LARGEST))])
    usable = (lens > 0) & (bad[ends] == bad[ends - lens])
    for d in np.unique(lens[usable]).tolist():
        at = np.flatnonzero(usable & (lens == d))
        yield at, np.floor(scaled[(ends - lens)[at][:, None] + np.arange(d)]).astype(np.int64)


def _keys(vectors: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Length and packed integers of the usable vectors.  Each vector takes the narrowest width that holds it, so equal ones get equal bytes."""
    for _, x in integer_rows(vectors):
        d = x.shape[1]
        most = np.maximum(x.max(axis=1), -1 - x.min(axis=1))
        width = np.select([most < 2**7, most < 2**15, most < 2**31], [1, 2, 4], 8)
        for w in np.unique(width).tolist():
            data = x[width == w].astype(f"<i{w}")
            ends = np.arange(len(data) + 1, dtype=np.int32) * (d * w)
            yield d, pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


def _unpacked(keys: pa.Array, d: int) -> np.ndarray:
    lens = pc.binary_length(keys).to_numpy(zero_copy_only=False)
    parts = []
    for size in np.unique(lens).tolist():
        raw = b"".join(keys.filter(pc.equal(pc.binary_length(keys), size)).to_pylist())
        parts.append(np.frombuffer(raw, f"<i{size // d}").reshape(-1, d).astype(np.int64))
    return np.concatenate(parts) if parts else np.zeros((0, d), np.int64)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Each usable vector once: dims, key (its packed integers).  Copies meet before the shuffle, so many of them are no hot key."""

    def run(batches):
        for b in batches:
            for d, keys in _keys(b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), d, np.int32)), keys], ["dims", "key"])

    return rows.mapInArrow(trimmed(run), "dims int, key binary").distinct()


# ---- whitening --------------------------------------------------------------------------------------------------


@dataclass
class Whitener:
    """What a fit gives: count and exact sums of the scaled vectors, components as columns, their eigenvalues and shares of the trace."""

    n: int
    total: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.total) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over the dimensions of (n*x - S)^2, exact; null where it is no 64-bit integer."""
        whole, rest = np.array([t // self.n for t in self.total], np.int64), [t % self.n for t in self.total]
        off = x - whole
        reach = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if x.shape[1] * reach * reach <= LONG:
            d = off * self.n - np.array(rest)
            return pa.array((d * d).sum(axis=1))
        about = (np.square(off * float(self.n) - np.array(rest, float))).sum(axis=1)
        out = []
        for row, size in zip(off, about.tolist(), strict=True):
            value = sum((int(o) * self.n - r) ** 2 for o, r in zip(row, rest, strict=True)) if size < 2 * LONG else LONG + 1
            out.append(value if value <= LONG else None)
        return pa.array(out, pa.int64())


def eigen(m: Moments, components: int) -> Whitener:
    """The components of the greatest eigenvalues; those whose eigenvalue is nothing but rounding are left out."""
    v = m.scatter / m.n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(initial=0), 0) * len(values) * np.finfo(float).eps]
    return Whitener(m.n, m.total, vectors[:, order], values[order], values[order] / np.trace(v))


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitener | None, float | None]:
    """The whitening of the distinct vectors, and the largest absolute entry of the whitened ones' covariance minus the identity.

    The first pass merges moments, the second one takes the moments of the whitened vectors.  Both read a written table of
    the distinct vectors, so neither repeats the shuffle.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    vectors = scratch.write(distinct_vectors(rows), "vectors")
    length = vectors.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()  # a row per length goes to the driver's top one
    if length is None:
        scratch.drop()
        return None, None
    d = length.dims
    keys = vectors.where(F.col("dims") == d).select("key")
    whitener = eigen(moments(keys, lambda b: _unpacked(b.column(0), d)), components)
    error = None
    if len(whitener.values):
        shared = spark.sparkContext.broadcast(whitener)  # components x dimensions doubles
        m = moments(keys, lambda b: shared.value.project(_unpacked(b.column(0), d)))
        error = float(np.abs(m.scatter / m.n - np.eye(len(whitener.values))).max())
    scratch.drop()
    return whitener, error


SCHEMA = "vec_id long, component int, deviation long, whitened double, explained double"


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    An entry c becomes x = floor(64 * c) + 1000000.  Mean and covariance V (divisor n, the number of distinct x vectors) are those of
    the distinct x vectors; components are unit eigenvectors of V by falling eigenvalue e, numbered from 1.  deviation is the exact
    sum of (n*x - S)^2 (null where it passes the range of long), whitened the centred x along the component over sqrt(e), explained
    e over V's trace, identity_error what the second pass measures.

    Vectors that are null or empty, that hold null or non-finite entries, or entries for which x is no 64-bit integer, give no rows.  All
    vectors need one length: that of most distinct ones (of equal numbers the longer); others give no rows.  Components without
    variance are left out: a table of one distinct vector gives no rows, nor does an empty one.  Repeated rows and null ids give rows like
    any other; equal eigenvalues leave the choice among their components open; other columns are left out.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    whitener, error = fit(rows.select(F.lit(None).cast("long").alias("vec_id"), "vector"), components)
    if whitener is None or error is None:
        out = spark.createDataFrame([], SCHEMA)
    else:
        out = _scored(rows, whitener)
    return out.select("vec_id", "component", F.lit(whitener.n if whitener else 0).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))


def _scored(rows: DataFrame, whitener: Whitener) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(whitener)

    def run(batches):
        w = shared.value
        k = len(w.values)
        for b in batches:
            for at, x in integer_rows(b.column(1)):
                if x.shape[1] != len(w.total):
                    continue
                each = np.repeat(np.arange(len(at)), k)
                columns = [b.column(0).take(pa.array(at)).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), w.deviations(x).take(pa.array(each)), pa.array(w.project(x).ravel()), pa.array(np.tile(w.explained, len(at)))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "deviation", "whitened", "explained"])

    return rows.mapInArrow(trimmed(run), SCHEMA)


def op12(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings)
