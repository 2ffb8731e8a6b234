import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from segmill.llm import katz as katz_module
from segmill.llm.common import crc_mod
from segmill.llm.katz import K, discounts, katz, op9


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


def brute(rows, is_train, order):
    counts, texts = [Counter() for _ in range(order)], 0
    for i, t in rows:
        if is_train(i):
            ts = tokens(t)
            texts += 1
            padded = ["<s>"] * (order - 1) + ts
            for n in range(1, order + 1):
                counts[n - 1].update(tuple(padded[k + order - n : k + order]) for k in range(len(ts)))
    words = counts[0]
    n, v = sum(words.values()), len(words)
    d = [discounts([sum(1 for x in c.values() if x == r) for r in range(1, K + 2)]) for c in counts]
    gone = sum((1 - d[0][c]) * c for c in words.values() if c <= K)
    total = lambda h: texts if set(h) == {"<s>"} else counts[len(h) - 1][h]
    after = defaultdict(list)
    for c in counts[1:]:
        for g in c:
            after[g[:-1]].append(g[-1])

    @lru_cache(None)
    def weight(h):
        return (1 - sum(prob(h, w) for w in after[h])) / (1 - sum(prob(h[1:], w) for w in after[h]))

    @lru_cache(None)
    def prob(h, w):
        if not h:
            return d[0][min(words[w,], K + 1)] * words[w,] / (n + 0.5) if words[w,] else (gone + 0.5) / (n + 0.5)
        c = counts[len(h)][*h, w]
        if c:
            return d[len(h)][min(c, K + 1)] * c / (total(h) + 1)
        return weight(h) * prob(h[1:], w) if h in after else prob(h[1:], w)

    out = {}
    for i, t in rows:
        ts = tokens(t)
        padded = ["<s>"] * (order - 1) + ts
        score = sum(math.log10(prob(tuple(padded[k : k + order - 1]), w)) for k, w in enumerate(ts))
        out[i] = (len(ts), sum(words[w,] > 0 for w in ts), n, sum(math.log10((words[w,] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), score)
    vocabulary = [*(w for (w,) in words), "never seen"]
    for h in [*list(after)[:20], *list(after)[-20:], ("nowhere",) * (order - 1)]:
        assert sum(prob(h, b) for b in vocabulary) == pytest.approx(1, abs=1e-9)
    return out


def make():
    rnd = random.Random(6)
    rows = []
    for i in range(150):
        rows.append((i, " ".join(rnd.choice(["the", "the", "of", "w%d" % rnd.randrange(60), "r%d" % rnd.randrange(5000), "THE", "É"]) for _ in range(rnd.randint(0, 60)))))
    return rows + [(900, None), (901, ""), (902, "the " * 30_000), (903, "x" * 50_000), (-5, "the of \n the")]


@pytest.mark.parametrize(("order", "small"), [(3, False), (3, True), (2, True), (4, True), (1, True)])
def test_same_as_brute_force(spark, order, small):
    rows = make()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, train int").repartition(3)
    is_train = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    want = brute(rows, is_train, order)
    sizes = {"block_bytes": 2000, "per_bucket": 5000} if small else {}  # many blocks and buckets, and hot contexts spread over them
    got = katz(df, crc_mod("doc_id", 5) != 1, order=order, **sizes).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], abs=1e-6) and r.score == pytest.approx(want[r.doc_id][4], abs=1e-6)
        assert r.train == is_train(r.doc_id)


def test_query_and_null_ids(spark):
    rows = make()
    want = brute(rows, lambda i: zlib.crc32(str(i).encode()) % 5 != 1, 3)
    df = spark.createDataFrame([*rows, (None, "the of")], "doc_id long, text string")
    got = {r.doc_id: r for r in op9(df).collect()}
    assert got.pop(None).held_out and {i: round(r.score, 5) for i, r in got.items()} == {i: round(x[4], 5) for i, x in want.items()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1) for i, r in got.items())


def test_no_rows_or_no_training(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert op9(df.where("doc_id < 0")).count() == 0
    got = {r.doc_id: r for r in katz(df, F.lit(False)).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].score <= 0 and got[2].n_tokens == 1


def test_repeated_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b a"), (1, "a b a"), (2, "b")], "doc_id long, text string").repartition(3)
    got = katz(df, F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 4, 4, 10), (1, 4, 4, 10), (2, 2, 2, 10)]
    assert len({r.score for r in got if r.doc_id == 1}) == 1


def test_distinct_values_and_rows():
    """As numpy's unique has them, whether or not a value and its place fit a word; rows of whole columns are sorted no more than once a column."""
    rnd = np.random.default_rng(1)
    for x in (np.zeros(0, np.int64), np.zeros(1, np.int64), rnd.integers(0, 50, 999), rnd.integers(0, 2**54, 999), rnd.integers(0, 2**62, 999), rnd.integers(0, 9, 500).astype(np.uint8)):
        assert all(np.array_equal(a, b) for a, b in zip(katz_module.distinct(x), np.unique(x, return_index=True, return_inverse=True), strict=True))
    for high in (7, 2**20, 2**50):
        columns = [rnd.integers(0, high, 3000) // d for d in (1, 2, 3)]
        code, first = katz_module._numbered(columns)
        rows = np.stack(columns, axis=1)
        _, at, inverse = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        assert np.array_equal(first, at) and np.array_equal(code, inverse.ravel())
    assert [len(x) for x in katz_module._numbered([np.zeros(0, np.int64)] * 2)] == [0, 0]


def test_each_part_tells_only_its_own_ngrams_apart(monkeypatch):
    rng, n, words = np.random.default_rng(5), 4000, 50
    local = np.concatenate([np.arange(words), rng.integers(0, words, n - words)])
    head = [np.arange(2, dtype=np.uint64), np.ones(2, np.uint8), np.array([1, 0], np.uint8), np.array([n - 1000, 1000]), rng.integers(8, 2**63, words).astype(np.uint64), local]
    told = [np.arange(1, words + 1), np.bincount(local[: n - 1000], minlength=words)]
    model = katz_module.Model(n - 1000, words, 1, [1] * (K + 1))
    block = katz_module.Block(katz_module.packed(*head, *told), 2)
    bigrams = len(block.grams[1][0])
    state = katz_module.packed(*head, *told, np.bincount(block.at[1][: n - 1000], minlength=bigrams), np.zeros(bigrams))
    trigrams = katz_module.Block(state, 3).grams[2]
    sorted_places, distinct = [], katz_module.distinct
    monkeypatch.setattr(katz_module, "distinct", lambda x: sorted_places.append(len(x)) or distinct(x))
    katz_module.Block(state, 2)
    dictionary, asked = sum(sorted_places), 0
    sorted_places.clear()
    for part in range(2):
        whole = katz_module.Block(state, 2)
        for bucket, data in katz_module._gram_requests(2, model, 7, part)(whole):
            runs, *_, own, low = katz_module.unpacked(data)
            assert bucket % 2 == part and runs.sum() == len(own) and (low[own > 0] > 0).all()
            asked += len(own)
    assert asked == len(trigrams[0])
    assert sum(sorted_places) == 2 * dictionary + n  # and not all tokens in both parts


def test_packed_arrays_come_back():
    arrays = [np.array([], np.int64), np.array([0, 255]), np.array([256, 1]), np.array([2**31, 7]), np.array([2**40, 3]), np.array([-1, 5]), np.array([0.5, -2.0]), np.array([2**64 - 1], np.uint64)]
    blob = katz_module.packed(*arrays)
    for a, x in zip(arrays, katz_module.unpacked(blob), strict=True):
        assert x.dtype == (np.float64 if a.dtype.kind == "f" else np.int64) and (x == a.astype(x.dtype)).all()
    for a, x in zip(arrays[:4], katz_module.unpacked(blob, narrow=True), strict=False):
        assert x.dtype == np.min_scalar_type(int(a.max()) if len(a) else 0) and (x == a).all()
