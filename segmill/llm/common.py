"""Shared pieces of the corpus operators: scratch tables, skew-safe helpers, byte-level word hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[Scratch] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "4m"  # of an Arrow batch, about; a longer row comes alone


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the Arrow batches of a session that has no bound of its own (Spark's is 64 MB), so that workers hold little at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def _trim() -> None:
    """Gives freed memory back to the system: workers are kept for later tasks, and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function that ends each task with little memory."""

    def wrapped(batches):
        yield from run(batches)
        _trim()

    return wrapped


def trimmed_group(run: Callable) -> Callable:
    """A pandas function of one group that ends with little memory."""

    def wrapped(pdf):
        out = run(pdf)
        _trim()
        return out

    return wrapped


class Scratch:
    """Parquet tables in the folder that ``spark.checkpoint.dir`` names, to cut lineage.

    The folder is shared by the driver and all executors, so a table outlives any executor.  Where the setting is
    missing (tests, a single machine) a folder of the driver's own is taken, which only ``local[*]`` masters may use.
    Tables are removed with :meth:`drop`, or when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="segmill-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        bounded_batches(spark)
        _SCRATCH.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes and rereads a table.  The shuffle files of its plan go as soon as it is written: nothing reads them again."""
        path, before = f"{self.root}/{name}", self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that no later plan reads; without a name, all of them."""
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            hpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hpath, True)


@atexit.register
def _drop_all() -> None:
    for s in _SCRATCH:
        try:
            s.drop()
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, null text as empty: no other column can clash with what an operator adds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc_mod(col: str, n: int):
    """crc32 of the id as decimal text, modulo ``n``: the folds that the query contracts name."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


# ---- byte-level words -------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240117)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C17 | 3)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_C = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW.get("n", 0) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        for key, base in (("p", _BASE), ("q", _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POW[key] = np.multiply.accumulate(x)
        _POW["n"] = size
    return _POW["p"], _POW["q"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (three xor-shift-multiply steps)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and how many words each text has.

    A word is a run of bytes other than space and 0x09-0x0D, with A-Z in lower case.  UTF-8 never uses these bytes inside
    a longer character, so bytes and characters give the same words.  A word's hash is a polynomial modulo 2**64 over
    random byte values, taken as a difference of prefix sums, then mixed.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edge[::2] if space[0] else np.concatenate([[0], edge[1::2]])
    ends = edge[1::2] if space[0] else edge[::2]
    p, q = _powers(len(buf))
    sums = np.cumsum(_BYTE[_LOWER][buf] * p[: len(buf)])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    h = mix64((sums[ends - 1] - before) * q[starts])
    return h, np.diff(np.searchsorted(starts, ends_of), prepend=0)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles, end to end, and the size of each set.

    A text of fewer than ``k`` words has its whole sequence as its one shingle; a text without words has none.
    """
    h, n = word_hashes(texts)
    total = len(h)
    acc = np.zeros(total, np.uint64)
    for i in range(k):
        acc[: total - i] += h[i:] * _C[i]
    acc = mix64(acc)
    first = np.cumsum(n) - n
    out, sizes = [], np.zeros(len(texts), np.int64)
    for d in range(len(texts)):
        m, s = int(n[d]), int(first[d])
        if m >= k:
            x = np.sort(acc[s : s + m - k + 1])
            x = x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x
        elif m:
            x = mix64(np.array([int(np.sum(h[s : s + m] * _C[:m], dtype=np.uint64)) ^ (m * 0x5851F42D4C957F2D & 2**64 - 1)], np.uint64))
        else:
            continue
        out.append(x)
        sizes[d] = len(x)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def in_chunks(batch, text_col: int, limit: int = 2_000_000):
    """Slices of an Arrow batch with about ``limit`` bytes of text each (one longer text comes alone)."""
    lens = np.asarray(batch.column(text_col).cast("binary").to_numpy(zero_copy_only=False), object)
    lens = [len(x) if x is not None else 0 for x in lens]
    start, size = 0, 0
    for i, n in enumerate(lens):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lens):
        yield batch.slice(start)
