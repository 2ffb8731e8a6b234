"""Nearest neighbours by cosine: a block matrix join with int8 product tiles, error bounds and exact recomputation."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, trimmed_group

QUERY_BLOCK, ROW_BLOCK = 4096, 16384  # rows of a tile's two sides, about


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision, every sum taken from the first component to the last.

    Rows are scaled by powers of two first, which changes no digit of the result but keeps squares of huge and tiny components in range.
    """
    q, x = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) for v in (q, x))
    dot, qq, xx = (np.zeros(len(q)) for _ in range(3))
    for i in range(q.shape[1]):
        dot += q[:, i] * x[:, i]
        qq += q[:, i] * q[:, i]
        xx += x[:, i] * x[:, i]
    return dot / (np.sqrt(qq) * np.sqrt(xx))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 codes; each row's scale, the norm of its scaled codes and the norm of what they leave out."""
    # scaled by a power of two first: that keeps squares of huge and tiny values in range
    unit = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    kept = codes * scale[:, None]
    return codes, scale, np.sqrt((kept * kept).sum(axis=1)), np.sqrt(((unit - kept) ** 2).sum(axis=1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 codes.  In 32-bit floats they are exact up to 1,000 components; beyond, in 64 bits."""
    kind = np.float32 if a.shape[1] <= 1000 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def tile_nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The ``k`` nearest rows of ``x`` to each query, exactly.

    With codes c, scales s and residuals e, unit vectors u = s*c + e, so the cosine differs from s*s'*(c.c') by at most
    |s*c||e'| + |e||s'*c'| + |e||e'|.  A row can only be among the nearest if its upper bound reaches the k-th greatest
    lower bound; those rows are recomputed in double precision, and a heap keeps the best.
    """
    qc, qs, qn, qe = quantise(q)
    xc, xs, xn, xe = quantise(x)
    out = []
    for at in range(0, len(q), 256):
        part = slice(at, at + 256)
        mid = _products(qc[part], xc) * (qs[part, None] * xs)
        slack = qn[part, None] * xe + qe[part, None] * (xn + xe) + 1e-9
        mid[q_ids[part, None] == ids] = -np.inf
        low = mid - slack
        kth = np.partition(low, max(0, low.shape[1] - k), axis=1)[:, max(0, low.shape[1] - k)] if low.shape[1] > k else np.full(len(low), -np.inf)
        rows, cols = np.nonzero((mid + slack >= kth[:, None]) & (mid > -np.inf))
        exact = cosines(q[part][rows], x[cols])
        best: dict[int, list] = {}
        for r, i, s in zip(rows.tolist(), ids[cols].tolist(), exact.tolist(), strict=True):
            heap = best.setdefault(r, [])
            if len(heap) < k:
                heapq.heappush(heap, (s, -i))
            elif (s, -i) > heap[0]:
                heapq.heapreplace(heap, (s, -i))
        out.extend((int(q_ids[at + r]), -i, s) for r, heap in best.items() for s, i in heap)
    return out


def _tile(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(left) and len(right):
            by_size = {n: g for n, g in right.groupby(right.j_v.map(len))}
            for n, qs in left.groupby(left.i_v.map(len)):
                if n in by_size:
                    rows = by_size[n]
                    out += tile_nearest(qs.i_id.to_numpy(), np.array(qs.i_v.tolist(), np.float64), rows.j_id.to_numpy(), np.array(rows.j_v.tolist(), np.float64), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _merge(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heap = heapq.nsmallest(k, zip((-pdf.score).tolist(), pdf.vec_id.tolist(), strict=True))
        return pd.DataFrame({"query_id": [int(pdf.query_id.iloc[0])] * len(heap), "rank": np.arange(1, len(heap) + 1, dtype=np.int32), "vec_id": [i for _, i in heap], "score": [-s for s, _ in heap]})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """Each query's ``k`` nearest rows by cosine, itself left out: query_id, rank (from 1), vec_id, score.

    Rows are dealt by a hash of their ids into blocks of about ``row_block``, queries into blocks of about ``query_block``; each pair of
    blocks is a tile that one task works on, so no side is broadcast and no task grows with the input.  A tile returns
    ``k`` rows per query at most; heaps merge them.  The result is exact: the int8 codes only tell which rows cannot matter.

    Ties go to the smaller id.  Null and zero vectors and vectors with a null or non-finite component take no part; nor do
    null ids.  Vectors meet only vectors of the same length.  A query with fewer candidates gets them all, one without none has no
    row.  No row is near a query of its own id.  A repeated query row asks once; a repeated candidate row counts as often as it stands there; a query id with
    several vectors gets the nearest of all of them.  An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    v = F.col(vector_col).cast("array<double>")
    fine = F.exists("v", lambda c: c != 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("q")).where("id is not null and v is not null").where(fine)
    rows = scratch.write(rows, "rows")
    n, m = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    row_blocks, query_blocks = -(-max(1, n) // row_block), -(-max(1, m) // query_block)

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        df = df.select(F.col("id").alias(f"{own}_id"), F.col("v").alias(f"{own}_v"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(own))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    queries = dealt(rows.where("q").dropDuplicates(["id", "v"]), "i", query_blocks, "j", row_blocks)
    cands = dealt(rows, "j", row_blocks, "i", query_blocks)
    found = queries.groupBy("i", "j").cogroup(cands.groupBy("i", "j")).applyInPandas(_tile(k), "query_id long, vec_id long, score double")
    return found.groupBy("query_id").applyInPandas(trimmed_group(_merge(k)), "query_id long, rank int, vec_id long, score double")


def op5(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 50 == 0)


ORACLE = """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
    p AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS i, len(e) AS n FROM v),
    ok AS (SELECT vec_id, any_value(n) AS n, sqrt(sum(x * x ORDER BY i)) AS norm FROM p GROUP BY vec_id
           HAVING count(x) = any_value(n) AND bool_and(isfinite(x)) AND bool_or(x <> 0)),
    d AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x ORDER BY a.i) AS dot FROM p a JOIN p b ON a.i = b.i AND a.n = b.n AND a.vec_id <> b.vec_id
          WHERE a.vec_id % 50 = 0 GROUP BY 1, 2),
    s AS (SELECT query_id, d.vec_id, dot / (q.norm * c.norm) AS score FROM d JOIN ok q ON q.vec_id = query_id JOIN ok c ON c.vec_id = d.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
