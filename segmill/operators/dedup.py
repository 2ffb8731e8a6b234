"""Similar segments: the ordered merge/drop/new rule.  The unordered form is in :mod:`segmill.operators.similar`."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.functions.hashes import hamming

MERGE_P, MERGE_C = 3, 2  # greatest distances to the open segment that still continue it
DROP_P, DROP_C = 5, 3  # greatest distances to any accepted segment that make a repeat

_ACC = "struct<open: boolean, p: bigint, c: bigint, seen: array<struct<p: bigint, c: bigint>>, done: array<struct<t: double, dur: double, parts: bigint>>>"


def merge_drop_new(candidates: Column) -> Column:
    """(t, dur, parts) of the segments that an ordered array of (t, dur, p, c) leaves.

    A candidate close to the open segment extends it (durations add up; the open segment's hashes stay).  Else one close to any
    accepted segment is dropped and closes the open one.  Else it opens a new segment and its hashes are accepted.
    A candidate without hashes changes nothing.
    """

    def step(a: Column, x: Column) -> Column:
        merge = a["open"] & (hamming(x["p"], a["p"]) <= MERGE_P) & (hamming(x["c"], a["c"]) <= MERGE_C)
        repeat = F.exists(a["seen"], lambda q: (hamming(q["p"], x["p"]) <= DROP_P) & (hamming(q["c"], x["c"]) <= DROP_C))
        last = F.element_at(a["done"], -1)
        longer = F.struct(last["t"].alias("t"), (last["dur"] + x["dur"]).alias("dur"), (last["parts"] + 1).alias("parts"))
        grown = F.concat(F.slice(a["done"], F.lit(1), F.size(a["done"]) - 1), F.array(longer))
        own = F.struct(x["p"].alias("p"), x["c"].alias("c"))
        fresh = F.struct(x["t"].alias("t"), x["dur"].alias("dur"), F.lit(1).cast("long").alias("parts"))

        def state(open_: Column, p: Column, c: Column, seen: Column, done: Column) -> Column:
            return F.struct(open_.alias("open"), p.alias("p"), c.alias("c"), seen.alias("seen"), done.alias("done")).cast(_ACC)

        return (
            F.when(x["p"].isNull() | x["c"].isNull(), a)
            .when(merge, state(F.lit(True), a["p"], a["c"], a["seen"], grown))
            .when(repeat, state(F.lit(False), a["p"], a["c"], a["seen"], a["done"]))
            .otherwise(state(F.lit(True), x["p"], x["c"], F.array_append(a["seen"], own), F.array_append(a["done"], fresh)))
        )

    empty = F.struct(F.lit(False).alias("open"), F.expr("0L").alias("p"), F.expr("0L").alias("c"), F.array().alias("seen"), F.array().alias("done")).cast(_ACC)
    return F.aggregate(candidates, empty, step, lambda a: a["done"])


class Accepted:
    """Accepted hash pairs, found by blocks: of six blocks of ``p`` a repeat within DROP_P bits has one unchanged, of four blocks of ``c`` one within DROP_C."""

    P_CUTS = [(64 * k // (DROP_P + 1), 64 * (k + 1) // (DROP_P + 1)) for k in range(DROP_P + 1)]
    C_CUTS = [(24 * k // (DROP_C + 1), 24 * (k + 1) // (DROP_C + 1)) for k in range(DROP_C + 1)]

    def __init__(self):
        self._under: dict[tuple, list[tuple[int, int]]] = {}

    def _keys(self, p: int, c: int):
        ps = [(i, p >> lo & (1 << hi - lo) - 1) for i, (lo, hi) in enumerate(self.P_CUTS)]
        high = c >> 24  # bits of a hash that is wider than colour hashes are; they lie in the last block
        cs = [(j, c >> lo & (1 << hi - lo) - 1) for j, (lo, hi) in enumerate(self.C_CUTS)]
        cs[-1] = (*cs[-1], high)
        return [(*a, *b) for a in ps for b in cs]

    def repeats(self, p: int, c: int) -> bool:
        looked = set()
        for key in self._keys(p, c):
            for q in self._under.get(key, ()):
                if q not in looked:
                    if (q[0] ^ p).bit_count() <= DROP_P and (q[1] ^ c).bit_count() <= DROP_C:
                        return True
                    looked.add(q)
        return False

    def add(self, p: int, c: int) -> None:
        for key in self._keys(p, c):
            self._under.setdefault(key, []).append((p, c))


def long_merge_drop_new(candidates: DataFrame, key: str = "video_id", order: tuple[str, ...] = ("t",)) -> DataFrame:
    """key, seg, t, dur, parts, like :func:`merge_drop_new`, of candidates(key, t, dur, p, c) in timelines of any length.

    Rows come sorted by ``order``; what is held is the open segment and an index of the accepted hashes (:class:`Accepted`), so each candidate
    looks at few of them instead of all.  A timeline is one task, as each step depends on the one before.  Candidates without a hash change nothing;
    null keys are a timeline; equal places in the order are taken in any order.
    """
    kind = candidates.schema[key].dataType
    mask = (1 << 64) - 1

    def run(batches):
        now, accepted, is_open, lp, lc, seg = None, None, False, 0, 0, None
        count = 0
        for b in batches:
            done: list[tuple] = []
            for k, t, dur, p, c in zip(b.column(0), *(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if now is None or not k.equals(now):
                    if seg:
                        done.append((now.as_py(), *seg))
                    now, accepted, is_open, seg, count = k, Accepted(), False, None, 0
                p, c = p & mask, c & mask
                if is_open and (p ^ lp).bit_count() <= MERGE_P and (c ^ lc).bit_count() <= MERGE_C:
                    seg[2], seg[3] = seg[2] + dur if dur is not None and seg[2] is not None else None, seg[3] + 1
                elif accepted.repeats(p, c):
                    is_open = False
                else:
                    if seg:
                        done.append((now.as_py(), *seg))
                    accepted.add(p, c)
                    is_open, lp, lc, seg = True, p, c, [count, t, dur, 1]
                    count += 1
            if done:
                yield _segments(done, b.schema.field(0).type)
        if seg:
            yield _segments([(now.as_py(), *seg)], now.type)

    def _segments(rows, key_type):
        columns = list(zip(*rows, strict=True))
        types = [key_type, pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], [key, "seg", "t", "dur", "parts"])

    usable = candidates.where("p is not null and c is not null").repartition(key).sortWithinPartitions(key, *order)
    plain = usable.select(key, *(F.col(c).cast("double").alias(c) for c in ("t", "dur")), *(F.col(c).cast("long").alias(c) for c in ("p", "c")))
    return plain.mapInArrow(run, f"{key} {kind.simpleString()}, seg long, t double, dur double, parts long")
