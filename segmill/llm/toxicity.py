"""Toxicity scores: a bidirectional gated recurrent network with attention pooling over word and character inputs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _INV, _powers, bounded_batches, crc_mod, in_chunks, mix64, trimmed
from .gru import Adam, gradients, pad_rows, recurrent_params, states

WINDOW, STRIDE = 24, 12  # words; every position of a text lies in two windows, but for its ends
HIDDEN = 8
WORD_DIM, CHAR_DIM = 8, 8
GRAM, GRAM_BUCKETS = 4, 1 << 13  # hashed character grams, with word borders
MIN_DOCS = 4  # sampled documents that a word must stand in to have an input of its own
SAMPLE_PER_CLASS = 2000  # labelled documents of each class that a model is fitted on, at most
EARLY_WINDOWS = 3  # windows of a document in each early pass
EMPTY = -4.0  # logit of a text without a word
EMBED_RATE = 15.0  # step of the word and character tables
CHUNK = 1_000_000  # bytes whose words are hashed at a time
_F = np.float32
_U = np.uint64

# Bytes that belong to words: letters in lower case, digits, and every byte of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[ord("a") : ord("z") + 1] = _WORD[ord("0") : ord("9") + 1] = _WORD[128:] = True


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes; hash, start and end of every word; how many words each (lower-cased) text has."""
    parts, at, base = [], 0, 0
    while at < len(texts) or not parts:
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        buf = np.frombuffer(b"\n" + b"\n".join(texts[at:end]) + b"\n", np.uint8)
        inside = _WORD[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        p, q = _powers(len(buf))
        sums = _BYTE[buf]
        sums *= p[: len(buf)]
        np.cumsum(sums, out=sums)
        h = mix64((sums[ends - 1] - sums[starts - 1]) * q[starts])
        limits = np.cumsum([len(t) + 1 for t in texts[at:end]])
        parts.append((buf, h, starts + base, ends + base, np.diff(np.searchsorted(starts, limits), prepend=0)))
        base, at = base + len(buf), end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def grams_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character grams of the given words (a border on either side), and how many each word has."""
    lens = ends - starts + 2
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) - np.repeat(first - starts + 1, lens)
    chars = _BYTE[buf[at]]
    chars[first] = chars[first + lens - 1] = _U(0x5851F42D4C957F2D)
    n = np.maximum(1, lens - GRAM + 1)
    begin = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    acc = np.zeros(len(begin), np.uint64)
    padded = np.concatenate([chars, np.zeros(GRAM, np.uint64)])
    for i in range(GRAM):
        acc = acc * _INV + padded[begin + i]
    return (mix64(acc) % _U(GRAM_BUCKETS)).astype(np.int64), n


class Model:
    def __init__(self, vocabulary: np.ndarray, params: dict[str, np.ndarray]):
        self.vocabulary, self.p = vocabulary, params  # sorted hashes; row 0 of the word table is for all other words

    def _inputs(self, word: np.ndarray, grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chars = np.add.reduceat(self.p["char"][grams], np.cumsum(n) - n, axis=0) / n[:, None].astype(_F)
        return np.concatenate([self.p["word"][word], chars], axis=1), chars

    def rows_of(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, h), max(0, len(self.vocabulary) - 1))
        return np.where(self.vocabulary[at] == h, at + 1, 0) if len(self.vocabulary) else np.zeros(len(h), np.int64)

    def _head(self, out: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window logits by attention: weights over positions, then a linear layer over the weighted state."""
        s = np.where(real, out @ self.p["v"], _F(-1e9))
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        ctx = np.einsum("tb,tbh->bh", a, out)
        return ctx @ self.p["w"] + self.p["b"][0], a, ctx

    def window_logits(self, symbols: np.ndarray, inputs: np.ndarray, block: int = 1024) -> np.ndarray:
        gates = pad_rows(np.stack([inputs @ self.p["x"][d] + self.p["xb"][d] for d in (0, 1)]))
        logits = np.empty(len(symbols), _F)
        for i in range(0, len(symbols), block):
            x = symbols[i : i + block]
            logits[i : i + block] = self._head(states(x, gates, self.p["u"], self.p["bn"]), x.T < len(inputs))[0]
        return logits

    def highest(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per text, the highest logit of all its windows, and whether it has a word (else the logit is that of EMPTY)."""
        buf, h, starts, ends, n = words_of(texts)
        top = np.full(len(texts), -np.inf)
        if len(h):
            symbols, inputs, owner = self.prepared(buf, h, starts, ends, n)
            np.maximum.at(top, owner, self.window_logits(symbols, inputs).astype(np.float64))
        return np.where(n > 0, np.clip(top, -20, 20), EMPTY), n > 0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        slope, offset = self.p["scale"]
        top, worded = self.highest(texts)
        return 1 / (1 + np.exp(-np.where(worded, np.clip(slope * top + offset, -30, 30), EMPTY)))

    def prepared(self, buf, h, starts, ends, n):
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        inputs, _ = self._inputs(self.rows_of(unique), *grams_of(buf, starts[first], ends[first]))
        symbols, owner = windows(inverse, n, len(unique))
        return symbols, inputs, owner

    @staticmethod
    def learn(texts: list[bytes], toxic: np.ndarray, share: float) -> Model:
        """Fits on four fifths of the sampled documents and calibrates on the rest."""
        rest = np.zeros(len(texts), bool)
        for y in (0, 1):
            rest[np.flatnonzero(toxic == y)[::5]] = True
        model = Model.fit([t for t, r in zip(texts, rest, strict=True) if not r], toxic[~rest])
        model.calibrate([t for t, r in zip(texts, rest, strict=True) if r], toxic[rest], share)
        return model

    @staticmethod
    def fit(texts: list[bytes], toxic: np.ndarray, steps: int = 100, seed: int = 11) -> Model:
        """Learns from document labels, by backpropagation through time.  Three early passes take some windows of each document at
        random under its label.  The later ones (five at least, and enough for ``steps`` updates) score all windows, then train on each
        document's highest, and on a second one at random where the label is 0."""
        rng = np.random.default_rng(seed)
        buf, h, starts, ends, n = words_of(texts)
        doc = np.repeat(np.arange(len(texts)), n)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        in_docs = np.bincount(np.unique(np.stack([inverse, doc]), axis=1)[0], minlength=len(unique)) if len(h) else np.zeros(0)
        k, dim = HIDDEN, WORD_DIM + CHAR_DIM
        vocabulary = unique[in_docs >= MIN_DOCS]
        p = recurrent_params(rng, k) | {
            "word": (0.1 * rng.standard_normal((len(vocabulary) + 1, WORD_DIM))).astype(_F), "char": (0.1 * rng.standard_normal((GRAM_BUCKETS, CHAR_DIM))).astype(_F),
            "x": (rng.standard_normal((2, dim, 3 * k)) / np.sqrt(dim)).astype(_F), "xb": np.zeros((2, 3 * k), _F), "v": np.zeros(2 * k, _F),
            "w": (rng.standard_normal(2 * k) / np.sqrt(k)).astype(_F), "b": np.zeros(1, _F),
        }
        model = Model(vocabulary, p | {"scale": np.array([1.0, 0.0])})
        if not len(h) or len(set(toxic.tolist())) < 2:
            p["w"][:], p["b"][0] = 0, 4 if len(toxic) and toxic.all() else -4
            return model
        word = model.rows_of(unique)
        grams, n_grams = grams_of(buf, starts[first], ends[first])
        g_first = np.cumsum(n_grams) - n_grams
        symbols, owner = windows(inverse, n, len(unique))
        size, early = 192, 3
        opt = Adam(p, 0.02, ("word", "char"), EMBED_RATE)
        passes = early + max(5, min(40, -(-steps * size // len(texts))))
        for turn in range(passes):
            pick = rng.permutation(len(owner))
            if turn < early:  # several windows of each document, under the document's label
                rank = np.empty(len(owner), np.int64)
                by = np.argsort(owner[pick], kind="stable")
                new = np.flatnonzero(np.concatenate([[True], owner[pick][by][1:] != owner[pick][by][:-1]]))
                rank[by] = np.arange(len(owner)) - np.repeat(new, np.diff(np.append(new, len(owner))))
                pick = pick[rank < EARLY_WINDOWS]
            else:
                second = pick[np.unique(owner[pick], return_index=True)[1]]
                logits = model.window_logits(symbols, model._inputs(word, grams, n_grams)[0])
                by = np.lexsort((logits, owner))
                top = by[np.flatnonzero(np.concatenate([owner[by][1:] != owner[by][:-1], [True]]))]
                pick = rng.permutation(np.unique(np.concatenate([top, second[toxic[owner[second]] == 0]])))
            y_all = toxic[owner[pick]]
            weight = (len(y_all) / (2 * np.maximum(1, np.bincount(y_all, minlength=2))))[y_all].astype(_F) if turn < early else np.ones(len(y_all), _F)
            opt.rate, opt.plain_rate = 0.02 * (1 - turn / passes), EMBED_RATE * (1 - turn / passes)
            for i in range(0, len(pick), size):
                used, local = np.unique(symbols[pick[i : i + size]], return_inverse=True)
                pads = used[-1] == len(unique)
                real_used = used[:-1] if pads else used
                x = local.reshape(-1, WINDOW)
                g_n = n_grams[real_used]
                g_at = np.repeat(g_first[real_used] - (np.cumsum(g_n) - g_n), g_n) + np.arange(int(g_n.sum()))
                inputs, _ = model._inputs(word[real_used], grams[g_at], g_n)
                gates = pad_rows(np.stack([inputs @ p["x"][d] + p["xb"][d] for d in (0, 1)]))
                tape: list = []
                out = states(x, gates, p["u"], p["bn"], tape)
                real = x.T < len(real_used)
                logit, a, ctx = model._head(out, real)
                y, wt = y_all[i : i + size], weight[i : i + size]
                d_logit = ((1 / (1 + np.exp(-logit)) - y) * wt / len(y)).astype(_F)
                d_ctx = d_logit[:, None] * p["w"]
                d_a = np.einsum("tbh,bh->tb", out, d_ctx)
                d_s = a * (d_a - (a * d_a).sum(axis=0))
                d_out = a[..., None] * d_ctx + d_s[..., None] * p["v"]
                d_gates, du, dbn = gradients(x, gates.shape, p["u"], tape, d_out)
                d_gates = d_gates[:, : len(real_used)]
                d_in = sum(d_gates[d] @ p["x"][d].T for d in (0, 1))
                d_word, d_char = np.zeros_like(p["word"]), np.zeros_like(p["char"])
                np.add.at(d_word, word[real_used], d_in[:, :WORD_DIM])
                d_word[0] = 0
                np.add.at(d_char, grams[g_at], np.repeat(d_in[:, WORD_DIM:] / g_n[:, None], g_n, axis=0).astype(_F))
                opt.step({
                    "u": du, "bn": dbn, "word": d_word, "char": d_char, "x": np.stack([inputs.T @ d_gates[d] for d in (0, 1)]), "xb": d_gates.sum(axis=1),
                    "v": np.einsum("tb,tbh->h", d_s, out), "w": ctx.T @ d_logit, "b": d_logit.sum(keepdims=True),
                })
        return model

    def calibrate(self, texts: list[bytes], toxic: np.ndarray, share: float) -> None:
        """Fits slope and offset of the highest logit on documents left out of training, weighted to the true share of label 1."""
        y = toxic.astype(np.float64)
        if len(set(y.tolist())) < 2:
            return
        x, _ = self.highest(texts)
        share = min(0.99, max(0.01, share))
        w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        f = np.stack([x / 4, np.ones_like(x)])
        beta = np.array([4.0, 0.0])
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(beta @ f, -30, 30)))
            grad = f @ (w * (q - y)) + 0.1 * (beta - [4.0, 0.0])
            hess = (f * (w * q * (1 - q))) @ f.T + 0.1 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            beta -= step / max(1.0, np.abs(step).max())
        self.p["scale"] = np.array([max(0.05, beta[0] / 4), beta[1]])


def windows(symbol: np.ndarray, n: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of all texts, as rows of symbols (padded), and the text of each."""
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(k * STRIDE, np.maximum(0, n[owner] - WINDOW))  # the last window ends with the text
    at = begin[:, None] + np.arange(WINDOW)
    first = (np.cumsum(n) - n)[owner]
    padded = np.concatenate([symbol, np.full(WINDOW, pad, symbol.dtype)])
    rows = padded[np.minimum(first[:, None] + at, len(symbol))]
    rows[at >= n[owner][:, None]] = pad
    return rows, owner


def sample(docs: DataFrame, labels: DataFrame, train, id_col: str, text_col: str, label_col: str) -> tuple[list, float]:
    """Whole texts of at most SAMPLE_PER_CLASS labelled documents of either class, chosen by a hash of their ids; the share of label 1."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(train).where("toxic in (0, 1) and id is not null")
    ids = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CLASS)
        ids = part if ids is None else ids.unionByName(part)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")  # bounded: 2 * SAMPLE_PER_CLASS
    texts = sorted((r.toxic, (r.text or "").lower().encode()) for r in rows.select("toxic", "text").collect())
    return texts, float(known.agg(F.avg("toxic")).first()[0] or 0)


def _score(shared):
    def run(batches):
        model = shared.value
        for whole in batches:
            for b in in_chunks(whole, "text", 800_000):
                texts = [(t or "").lower().encode() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(texts))], ["doc_id", "score"])

    return trimmed(run)


def _keep(shared, text_col: str):
    def run(batches):
        for whole in batches:
            for b in in_chunks(whole, text_col, 800_000):
                scores = shared.value.scores([(t or "").lower().encode() for t in b.column(text_col).to_pylist()])
                yield b.filter(pa.array(scores < 0.5))

    return trimmed(run)


def _learnt(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None, train, id_col: str, text_col: str, label_col: str):
    rows, share = sample(docs if labelled is None else labelled, labels, F.lit(True) if train is None else train, id_col, text_col, label_col)
    bounded_batches(docs.sparkSession)
    model = Model.learn([t for _, t in rows], np.array([y for y, _ in rows], np.int64), share)
    return docs.sparkSession.sparkContext.broadcast(model)  # some MB: bounded by the sample


def keep_harmless(docs: DataFrame, labels: DataFrame, train=None, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`toxicity` does not predict as toxic; one pass without a shuffle.

    Null and empty texts stay.  Rows are judged by themselves: repeated rows, null ids and further columns do not matter; an empty table gives no rows.
    """
    shared = _learnt(docs, labels, labelled, train, id_col, text_col, label_col)
    return docs.mapInArrow(_keep(shared, text_col), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, train=None, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= 0.5, else 0).

    A text's words (letters and digits, lower-cased) are cut into windows of WINDOW words, STRIDE apart; the network reads each
    in both directions, from an input that joins the word's own vector (for words of the training sample) with the mean of its
    hashed character grams, pools the states by attention, and gives a probability.  The document's score is its highest.
    The model is fitted on at most SAMPLE_PER_CLASS documents of each class of ``labels`` that meet ``train``, joined with ``labelled``
    (``docs`` by default).  Null, empty or wordless text scores 0.018, and so does every text without any label.  With labels of one
    class only, texts with a word score 0.018 (label 0) or 0.982 (label 1).  Repeated and very long texts are no matter: rows are scored one by one,
    as are repeated and null ids; a tie at 0.5 is predicted 1; an empty table gives no rows; other columns are ignored.
    """
    shared = _learnt(docs, labels, labelled, train, id_col, text_col, label_col)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(shared), "doc_id long, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(docs, labels, train=crc_mod("id", 5) != 0)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
