import random

import numpy as np

from segmill.llm import langid, toxicity
from segmill.llm.gru import gradients, pad_rows, recurrent_params, states


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    p = recurrent_params(rng, 3)
    table = rng.standard_normal((2, 5, 9)).astype(np.float32)
    x = np.array([[0, 1, 2, 5], [3, 3, 5, 5], [4, 0, 1, 2]])
    target = rng.standard_normal((4, 3, 6)).astype(np.float32)
    real = (x.T < 5)[..., None]

    def loss(table, u, bn):
        return float((states(x, pad_rows(table), u, bn) * target * real).sum(dtype=np.float64))

    tape = []
    gates = pad_rows(table)
    states(x, gates, p["u"], p["bn"], tape)
    got = gradients(x, gates.shape, p["u"], tape, target * real)
    for k, grad in enumerate((got[0][:, :5], got[1], got[2])):
        for _ in range(8):
            at = tuple(rng.integers(0, n) for n in grad.shape)
            sides = []
            for e in (1e-2, -1e-2):
                args = [table.copy(), p["u"].copy(), p["bn"].copy()]
                args[k][at] += e
                sides.append(loss(*args))
            assert abs((sides[0] - sides[1]) / 2e-2 - grad[at]) < 2e-2 + 0.02 * abs(grad[at])


def test_padding_leaves_a_state_alone():
    rng = np.random.default_rng(1)
    p = recurrent_params(rng, 4)
    gates = pad_rows(rng.standard_normal((2, 6, 12)).astype(np.float32))
    a = states(np.array([[1, 2, 3]]), gates, p["u"], p["bn"])
    b = states(np.array([[1, 2, 3, 6, 6]]), gates, p["u"], p["bn"])
    assert np.allclose(a, b[:3], atol=1e-6)


def test_language_held_out_accuracy(spark):
    rnd = random.Random(4)
    parts = {"aa": ["tha", "ing", "re", "on "], "bb": ["sch", "ung", "ä", "te "], "cc": ["ción", "ado", "os ", "la "]}
    rows = []
    for i in range(240):
        lang = rnd.choice(list(parts))
        text = "".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(20, 200)))
        rows.append((i, text, lang if i % 7 else None, "x"))
    rows += [(900, None, "aa", "x"), (901, "", "aa", "x"), (902, "12 -- 3!", "bb", "x"), (903, "schungte " * 30_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.op10(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "bb" and 0 <= got[903].score <= 1
    held = [r for r in rows[:240] if r[2] and got[r[0]].held_out]
    assert len(held) > 40 and sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.95


def test_language_without_labels_or_rows(spark):
    schema = "doc_id long, text string, lang string"
    assert [r.lang_pred for r in langid.op10(spark.createDataFrame([(1, "abc", None)], schema)).collect()] == ["und"]
    assert langid.op10(spark.createDataFrame([], schema)).count() == 0


def make(n, seed):
    rnd = random.Random(seed)
    clean = ["w%s" % "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(clean) for _ in range(rnd.randint(5, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 40):
                words.insert(rnd.randrange(len(words)), rnd.choice(["grobnik", "vulpak", "zurmix"]))
        rows.append((i, " ".join(words), "en", "s", 3.0))
        labels.append((i, None if i % 11 == 0 else 1, int(toxic)))
    return rows, labels


def test_toxicity_held_out_accuracy(spark):
    rows, labels = make(500, 6)
    rows += [(9000, None, "en", "s", 1.0), (9001, "", "en", "s", 1.0), (9002, "?! ...", "en", "s", 1.0), (9003, "wabc " * 40_000 + "vulpak", "en", "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    known = spark.createDataFrame(labels + [(5000, 1, 1), (None, 0, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.op3(docs, known).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [r for r in labels if got[r[0]].held_out]
    assert len(held) > 60 and sum(got[r[0]].predicted == r[2] for r in held) / len(held) > 0.93
    assert all(got[i].score < 0.1 for i in (9000, 9001, 9002)) and got[9003].predicted == 1  # a word at the very end counts


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.op3(docs, none).collect()] == [0, 0]
    assert toxicity.op3(docs.where("doc_id < 0"), none).count() == 0


def test_windows_overlap_and_cover():
    rows, owner = toxicity.windows(np.arange(61), np.array([3, 0, 24, 34]), 99)
    assert owner.tolist() == [0, 2, 3, 3] and rows[0].tolist() == [0, 1, 2] + [99] * 21
    assert rows[1].tolist() == list(range(3, 27)) and rows[2].tolist() == list(range(27, 51)) and rows[3].tolist() == list(range(37, 61))
    rows, owner = toxicity.windows(np.arange(61), np.array([61]), 99)
    assert set(rows.ravel().tolist()) == set(range(61)) and len(rows) == 5


def test_grams_have_word_borders():
    buf, h, starts, ends, n = toxicity.words_of([b"abcd xabcdy", b"abcd"])
    grams, counts = toxicity.grams_of(buf, starts, ends)
    assert counts.tolist() == [3, 5, 3] and grams[:3].tolist() == grams[8:].tolist() and grams[1] in grams[3:8]


def plain_gru(rows, u, bn):
    """States of one direction for gate inputs [t, 3h], one step at a time."""
    k, h, out = u.shape[0], np.zeros(u.shape[0]), []
    for x in rows:
        s = h @ u
        z, r = (1 / (1 + np.exp(-(x[a : a + k] + s[a : a + k]))) for a in (0, k))
        n = np.tanh(x[2 * k :] + r * (s[2 * k :] + bn))
        h = (1 - z) * n + z * h
        out.append(h)
    return np.array(out)


def both_ways(gates, p):
    return np.concatenate([plain_gru(gates[0], p["u"][0].astype(float), p["bn"][0, 0]), plain_gru(gates[1][::-1], p["u"][1].astype(float), p["bn"][1, 0])[::-1]], axis=1)


def test_language_scores_same_as_brute_force():
    from pyspark.sql import Row

    rnd = random.Random(2)
    rows = [Row(lang=lang, text="".join(rnd.choice(parts) for _ in range(rnd.randint(1, 90)))) for _ in range(20) for lang, parts in (("aa", ["the", " ing", "re"]), ("bb", ["schö", "ung ", "te"]))]
    model = langid.Model.fit(rows, passes=5)
    texts = [r.text.lower().encode() for r in rows[:6]] + [b"x" * 500]
    for text, got in zip(texts, model.pooled(texts), strict=True):
        total = np.zeros(2)
        for at in range(0, len(text), langid.STEPS):  # every byte counts once
            symbols = list(text[at : at + langid.STEPS])
            logits = both_ways(model.p["gates"][:, symbols].astype(float), model.p) @ model.p["v"] + model.p["c"]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            total += (e / e.sum(axis=1, keepdims=True)).sum(axis=0)
        assert np.allclose(got, total / len(text), atol=1e-5)


def test_toxicity_scores_same_as_brute_force():
    rows, labels = make(80, 3)
    texts = [t.encode() for _, t, *_ in rows]
    model = toxicity.Model.learn(texts, np.array([y for *_, y in labels]), 0.25)
    probe = [*texts[:6], b"", b"wab grobnik " * 40, " ".join(["x%d" % i for i in range(61)]).encode()]
    slope, offset = model.p["scale"]
    for text, got in zip(probe, model.scores(probe), strict=True):
        buf, h, starts, ends, n = toxicity.words_of([text])
        if not len(h):
            assert abs(got - 0.018) < 1e-3
            continue
        inputs, _ = model._inputs(model.rows_of(h), *toxicity.grams_of(buf, starts, ends))
        best = -np.inf
        for at in sorted({*range(0, max(1, len(h) - toxicity.WINDOW + 1), toxicity.STRIDE), max(0, len(h) - toxicity.WINDOW)}):
            window = inputs[at : at + toxicity.WINDOW].astype(float)
            out = both_ways(np.stack([window @ model.p["x"][d] + model.p["xb"][d] for d in (0, 1)]), model.p)
            s = out @ model.p["v"]
            a = np.exp(s - s.max())
            best = max(best, (a / a.sum()) @ out @ model.p["w"] + model.p["b"][0])
        assert np.isclose(got, 1 / (1 + np.exp(-(slope * np.clip(best, -20, 20) + offset))), atol=1e-4)


def test_words_are_the_same_in_chunks(monkeypatch):
    texts = [b"ab cd", b"", b"e" * 50, b"  x y ", b"ab"]
    whole = toxicity.words_of(texts)
    monkeypatch.setattr(toxicity, "CHUNK", 8)
    parts = toxicity.words_of(texts)
    assert whole[1].tolist() == parts[1].tolist() and whole[4].tolist() == parts[4].tolist() == [2, 0, 1, 2, 1]
    assert [bytes(parts[0][s:e]) for s, e in zip(parts[2], parts[3], strict=True)] == [b"ab", b"cd", b"e" * 50, b"x", b"y", b"ab"]


def test_one_class_of_labels_only(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "c"), (4, "d e f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 1), (4, 1)], "doc_id long, toxic int")
    got = {r.doc_id: round(r.score, 3) for r in toxicity.toxicity(docs, labels).collect()}
    assert got == {1: 0.982, 2: 0.018, 3: 0.982, 4: 0.982}


def test_languages_beyond_any_number_keep_a_first_document(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, "text of language %d" % (i % 250), "l%d" % (i % 250)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 400)
    got = langid.sample(docs, F.lit(True), "doc_id", "text", "lang")
    assert len(got) == 400 and len({r.lang for r in got}) == 250
