import random
import re

import numpy as np

from segmill.llm.common import Scratch, shingle_sets, word_hashes
from segmill.llm.components import components
from segmill.llm.minhash import near_duplicates, super_minhash


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((i, len(s), find(i), i == find(i)) for i, s in sets.items())


def make(seed=3):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["É", "naïve", "x y"]
    rows, base = [], [[rnd.choice(words) for _ in range(rnd.randint(30, 80))] for _ in range(25)]
    for i in range(400):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((i * 7 + 3, rnd.choice([" ", "  ", "\n", "\t "]).join(t).upper() if i % 5 == 0 else " ".join(t)))
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "one two"), (9005, "One  two"), (9006, "one two three four"), (9007, "z" * 200_000), (9008, "one"), (9009, "two one")]
    return rows


def run(spark, rows, k):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, component long").repartition(5)
    return sorted(map(tuple, near_duplicates(df, shingle=k).select("doc_id", "n_shingles", "component_id", "kept").collect()))


def test_same_as_brute_force(spark):
    rows = make()
    for k in (4, 5):
        assert run(spark, rows, k) == brute(rows, k)


def test_large_group_of_mutually_distant_copies(spark):
    """Copies of one text that is not there itself: near the threshold from each other, so many buckets stay open."""
    rnd = random.Random(5)
    base = ["b%d" % i for i in range(120)]
    rows = []
    for i in range(420):
        t = list(base)
        for p in rnd.sample(range(120), 3):
            t[p] = "n%d" % rnd.randrange(10**9)
        rows.append((i, " ".join(t)))
    assert run(spark, rows, 4) == brute(rows, 4)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_and_sets():
    h, n = word_hashes([b"Ab  ab\nAB", b"", b" x ", b"\tab"])
    assert n.tolist() == [3, 0, 1, 1] and len(set(h.tolist())) == 2 and h[0] == h[1] == h[2] == h[4]
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    _, sizes = shingle_sets([t.encode() for t in texts], 4)
    assert sizes.tolist() == [len(shingles(t, 4)) for t in texts]


def test_signature_estimates_similarity_with_low_variance():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(200):
        a = rng.integers(0, 2**63, 40, dtype=np.uint64)
        b = np.concatenate([a[:30], rng.integers(0, 2**63, 10, dtype=np.uint64)])
        sig = super_minhash(np.concatenate([a, b]), np.array([40, 40]), 160)
        errors.append((sig[0] == sig[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.6 * 0.4 / 160
    one = super_minhash(np.array([7], np.uint64), np.array([1]), 16)
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(16))  # one set element gives a permutation of ranks
    assert super_minhash(np.zeros(0, np.uint64), np.array([0]), 4).tolist() == [[2**64 - 1] * 4]


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 8), (5, 5), (8, 9)] + [(i, i + 1) for i in range(100, 140)] + [(200, j) for j in range(201, 260)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {i: 100 for i in range(100, 141)} | {i: 200 for i in range(200, 260)}


def test_repeated_rows(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (9, "a b c d e f g")]
    assert run(spark, rows, 5) == [(2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False), (9, 3, 9, True)]


def test_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (1, text), (2, text + " end"), (3, None), (None, "other words that stand alone here")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(1, 1, True), (2, 1, False), (3, 3, True)]
    assert all(not r.kept for r in got if r.doc_id is None)
