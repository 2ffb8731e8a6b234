"""Packing token sequences: local best fit, then tree merges of underfull bins as items."""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, trimmed, trimmed_group, whole_text

CAPACITY = 2048
END_ID = 0
NEARLY_FULL = 4  # a bin with no more free places than this goes out at once
GROUP = 16_384  # pieces that a first best fit gets, about
FAN_IN = 16  # groups that a merge round joins
CARRY = 4096  # underfull bins that a merged group hands up, at most; the others wait for the last round, which takes any number
CACHE = 200_000  # chunks whose ids a worker remembers

_SPACES = re.compile(r" \s")


class Encoder:
    """Token ids of whole texts with a public byte-level vocabulary, as little-endian unsigned 32-bit integers.

    The vocabulary's pattern starts a new pre-token at every space that is followed by a non-space, so a text without
    a space followed by white space is cut there, and each chunk's ids are remembered.  Other texts are encoded whole.
    Both ways give the ids that the library gives for the text by default: a special token's string in a text is that token, and texts with one go
    through the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(special)) if special else None
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self._plain = self._direct(tokenizer, vocabulary)
        self._library = tokenizer
        self._cache: dict[str, bytes] = {}

    @staticmethod
    def _direct(tokenizer, vocabulary):
        """The same vocabulary as byte ranks for the faster library; the first library itself if its ids differ on a probe."""
        import json

        import public_tokenizers
        import tiktoken

        def slow(text: str) -> list[int]:
            return tokenizer.encode(text, add_special_tokens=False).ids

        model = json.loads(tokenizer.to_str())["model"]
        bytes_of = {}
        free = 256
        for b in range(256):  # the byte alphabet of byte-level vocabularies: printable bytes stand for themselves
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
                bytes_of[chr(b)] = b
            else:
                bytes_of[chr(free)] = b
                free += 1
        added = {t["content"] for t in json.loads(tokenizer.to_str()).get("added_tokens", [])}
        ranks = {bytes(bytes_of[c] for c in t): i for t, i in vocabulary.items() if t not in added}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if model["type"] == "BPE" else None
        probe = "It's an odd  probe,\n\n\twith 12345 things -- été naïve ½ 日本語 🙂!!  <|endof> \n x y"
        return fast.encode_ordinary if fast and fast.encode_ordinary(probe) == slow(probe) else slow

    def _ids(self, text: str) -> bytes:
        return np.array(self._plain(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self._special and self._special.search(text):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _SPACES.search(text):
            return self._ids(text)
        head, *chunks = text.split(" ")
        cache = self._cache
        if len(cache) > CACHE:
            cache.clear()
        out = [self._ids(head)] if head else []
        for c in chunks:
            ids = cache.get(c)
            if ids is None:
                ids = self._ids(" " + c)
                if len(c) <= 64:
                    cache[c] = ids
            out.append(ids)
        return b"".join(out)


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One encoder per worker, whatever the number of its tasks."""
    return Encoder(path)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: the bin and offset of each item, and every bin's fill.  Ties go to the lower index."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # free places -> bins
    frees: list[int] = []  # sorted free places that some bin has
    for i in order.tolist():
        s = int(sizes[i])
        at = bisect.bisect_left(frees, s)
        if at < len(frees):
            free = frees[at]
            b = open_at[free].pop()
            if not open_at[free]:
                frees.pop(at)
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        free -= s
        if free:
            if not open_at[free]:
                bisect.insort(frees, free)
            open_at[free].append(b)
    return bins, offsets, fill


def best_fit_counts(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Best-fit decreasing of ``counts[s]`` items of every size s at once: items of a size are alike, and so are bins with the same free places.

    Runs of items, as arrays (size, first item, items, first bin, offset): the i-th item of a run goes to the i-th bin of its bins.  The work
    depends on the number of sizes, not of items.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    open_at: dict[int, list[tuple[int, int]]] = {}  # free places -> (first bin, bins)
    frees: list[int] = []
    made = 0

    def reopen(free: int, first: int, bins: int) -> None:
        if bins and free:
            if free not in open_at:
                bisect.insort(frees, free)
            open_at.setdefault(free, []).append((first, bins))

    def place(size: int, item: int, items: int, free: int, first: int, bins: int) -> int:
        """Fills bins one after another; returns the items that are placed."""
        each = free // size
        whole = min(bins, items // each)
        for k in range(each if whole else 0):
            runs.append((size, item + k * whole, whole, first, capacity - free + k * size))
        reopen(free - each * size, first, whole)
        done = whole * each
        if whole < bins and done < items:  # one bin more takes the few that are left
            for k in range(items - done):
                runs.append((size, item + done + k, 1, first + whole, capacity - free + k * size))
            reopen(free - (items - done) * size, first + whole, 1)
            whole, done = whole + 1, items
        reopen(free, first + whole, bins - whole)
        return done

    for size in range(capacity, 0, -1):
        item, items = 0, int(counts[size])
        while items:
            at = bisect.bisect_left(frees, size)
            if at < len(frees):
                free = frees[at]
                first, bins = open_at[free].pop()
                if not open_at[free]:
                    del open_at[free]
                    frees.pop(at)
            else:
                free, first, bins = capacity, made, -(-items // (capacity // size))
                made += bins
            done = place(size, item, items, free, first, bins)
            item, items = item + done, items - done
    return tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 5


def split_low(sizes: np.ndarray, bins: np.ndarray, offsets: np.ndarray, fill: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Takes bins that are not half full apart again, so that their items can fill gaps elsewhere in the next round."""
    fills = np.array(fill, np.int64)
    low = 2 * fills[bins] < capacity
    bins, offsets = bins.copy(), offsets.copy()
    bins[low] = len(fills) + np.arange(int(low.sum()))
    offsets[low] = 0
    return bins, offsets, np.concatenate([fills, sizes[low]])


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: whole if they fit, else full ones after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _sized(path: str, capacity: int):
    """Pieces of a partition's documents, and a running number, so that rows that repeat an id can be told apart."""

    def run(batches):
        from pyspark import TaskContext

        encoder, part, serial = _encoder(path), TaskContext.get().partitionId(), 0
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text) + END_ID.to_bytes(4, "little")
                for k, (start, n) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    for c, v in zip(cols, (i, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])), strict=True):
                        c.append(v)
            n = len(cols[0])
            out = [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols)] + [pa.array(np.full(n, part)), pa.array(np.arange(serial, serial + n))]
            serial += n
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "source", "serial"])

    return trimmed(run)


def _first(capacity: int):
    """Best fit of a group's pieces."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "serial"]).reset_index(drop=True)
        sizes = pdf.length.to_numpy()
        bins, offsets, fill = split_low(sizes, *best_fit(sizes, capacity), capacity)
        return pdf.drop(columns=["source", "serial"]).assign(bin=bins, offset=offsets, fill=fill[bins])

    return trimmed_group(run)


def _merge(capacity: int, last: bool, carry: int):
    """Best fit of a group's underfull bins, taken as items; ``up`` marks the bins that go on to the next round."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "part", "bin"]).reset_index(drop=True)
        sizes = pdf.fill.to_numpy()
        bins, offsets, fill = best_fit(sizes, capacity)
        if last:
            fills = np.array(fill, np.int64)
        else:
            bins, offsets, fills = split_low(sizes, bins, offsets, fill, capacity)
        under = (capacity - fills > NEARLY_FULL) & np.isin(np.arange(len(fills)), bins)
        up = under & (not last)
        if up.sum() > carry:
            up[np.argsort(np.where(up, fills, capacity + 1), kind="stable")[carry:]] = False
        return pd.DataFrame({"part": pdf.part, "bin": pdf.bin, "to_part": pdf.group, "to_bin": bins, "shift": offsets, "fill": fills[bins], "up": up[bins], "rest": (under & ~up)[bins]})

    return trimmed_group(run)


def _finish(runs: tuple[np.ndarray, ...], part: int):
    """Where the bins that are left go: each by its number among the bins of its fill."""
    size, first, items, to_bin, offset = runs
    order = np.lexsort((first, size))
    size, first, items, to_bin, offset = (x[order] for x in (size, first, items, to_bin, offset))
    keys = size << 44 | first

    def run(batches):
        for b in batches:
            fill, number = (b.column(c).to_numpy().astype(np.int64) for c in ("fill", "number"))
            at = np.searchsorted(keys, fill << 44 | number, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("bin"), pa.array(np.full(len(at), part)), pa.array(to_bin[at] + number - first[at]), pa.array(offset[at])], ["part", "bin", "to_part", "to_bin", "shift"])

    return run


MOVED = "part long, bin long, to_part long, to_bin long, shift long"
MERGED = f"{MOVED}, fill long, up boolean, rest boolean"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", group_size: int = GROUP, carry: int = CARRY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids (``tokenizer``: a file of the tokenizers library) and a closing id 0.  Documents longer than ``capacity`` are cut
    into full pieces, of which the first may be shorter.  The pieces' sizes are dealt by hash to groups of about GROUP, so each group has the whole table's lengths,
    in whatever order the files hold them.  A group packs its pieces by best fit, longest first; bins with
    at most NEARLY_FULL free places are done.  The others become items of their own (those not half full are taken apart again): rounds of best fit merge them over FAN_IN groups at
    a time, up a tree, until one group is left.  A group hands up at most CARRY bins, the emptiest, which bounds every task.  A last round packs all underfull bins
    that remain, from the root or held back on the way, however many: bins of the same fill are alike, so it needs only how many there are of each fill, and
    bins then find their places by their number among their like.  Only sizes move between tasks, not ids.

    Null text counts as empty: one piece that holds the closing id alone.  Repeated and null ids are packed once per row.  Of equal sizes the one
    that stands first in its group is packed first.
    An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, fill long"
    sized = whole_text(docs, id_col, text_col).mapInArrow(_sized(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, source long, serial long")
    sized = scratch.write(sized, "sized")
    groups = max(1, -(-sized.count() // group_size))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "source", "serial"), F.lit(groups)))
    pieces = scratch.write(dealt.groupBy("part").applyInPandas(_first(capacity), schema), "pieces")
    under = pieces.where(F.col("fill") < capacity - NEARLY_FULL).select("part", "bin", "fill").distinct()
    scratch.drop("sized")
    base, maps = groups, []
    width = groups
    while True:
        width = -(-width // FAN_IN)
        first = base
        items = under.withColumn("group", F.floor((F.col("part") - (F.lit(0) if not maps else F.lit(first - last_width))) / FAN_IN) + first)
        merged = scratch.write(items.groupBy("group").applyInPandas(_merge(capacity, width == 1, carry), MERGED), f"round-{len(maps)}")
        maps.append(merged)
        base, last_width = base + width, width
        if width == 1:
            break
        under = merged.where("up").select(F.col("to_part").alias("part"), F.col("to_bin").alias("bin"), "fill").distinct()
    rest = scratch.write(reduce(DataFrame.unionByName, [m.where("rest").select(F.col("to_part").alias("part"), F.col("to_bin").alias("bin"), "fill") for m in maps]).distinct(), "rest")
    per_part = rest.groupBy("part", "fill").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("fill").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = scratch.write(per_part.withColumn("before", F.coalesce(before, F.lit(0))), "starts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in starts.groupBy("fill").agg(F.sum("n").alias("n")).collect():  # a row per fill: at most ``capacity``
        counts[row.fill] = row.n
    own = F.row_number().over(Window.partitionBy("part", "fill").orderBy("bin")) - 1
    numbered = rest.withColumn("own", own).join(starts, ["part", "fill"]).select("part", "bin", "fill", (F.col("before") + F.col("own")).alias("number"))
    finish = scratch.write(numbered.mapInArrow(_finish(best_fit_counts(counts, capacity), base), MOVED), "finish")
    moved = finish  # where each underfull bin ends up, composed from the last round down
    for m in reversed(maps):
        later = moved.select(F.col("part").alias("to_part"), F.col("bin").alias("to_bin"), F.col("to_part").alias("p2"), F.col("to_bin").alias("b2"), F.col("shift").alias("s2"))
        here = m.select("part", "bin", "to_part", "to_bin", "shift").join(later, ["to_part", "to_bin"], "left")
        here = here.select("part", "bin", F.coalesce("p2", "to_part").alias("to_part"), F.coalesce("b2", "to_bin").alias("to_bin"), (F.col("shift") + F.coalesce("s2", F.lit(0))).alias("shift"))
        moved = here.unionByName(finish) if m is not maps[0] else here
    out = pieces.join(moved, ["part", "bin"], "left")
    at = F.coalesce("to_part", "part") * F.lit(1 << 32) + F.coalesce("to_bin", "bin")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", at.alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def op4(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
