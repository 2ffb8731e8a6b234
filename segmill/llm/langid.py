"""Language identification with a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, in_chunks, trimmed
from .gru import Adam, gradients, pad_rows, recurrent_params, states

HIDDEN = 8
STEPS = 96  # bytes that the network reads as one row
SAMPLE_PER_LANG = 400  # labelled documents per language that a model is fitted on, at most
SAMPLE_ROWS = 40_000  # of all languages together, at most; where that binds, every language has its first ones before any has more
DRAWS = 9  # rows that training draws per sampled document, about
_F = np.float32


def sample(docs: DataFrame, train, id_col: str, text_col: str, lang_col: str) -> list:
    """lang and whole text of at most SAMPLE_PER_LANG documents per language, chosen by a hash of their ids.

    The ranks need one pass over ids and languages (each task passes on no more than it may need), the texts another.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(train).where("lang is not null and text is not null and text <> ''")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ids = rows.select("id", "lang", rank.alias("rank")).where(F.col("rank") <= SAMPLE_PER_LANG).orderBy("rank", F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    picked = rows.join(F.broadcast(ids.select("id").distinct()), "id", "left_semi")  # bounded: SAMPLE_ROWS ids
    return sorted(picked.select("lang", "text").collect())


def _rows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all texts as rows of STEPS symbols (256: padding), and the text of each row."""
    lens = np.array([len(t) for t in texts], np.int64)
    n_rows = -(-lens // STEPS)
    owner = np.repeat(np.arange(len(texts)), n_rows)
    row = np.arange(len(owner)) - np.repeat(np.cumsum(n_rows) - n_rows, n_rows)
    buf = np.frombuffer(b"".join(texts) + b"\0" * STEPS, np.uint8)
    start = (np.cumsum(lens) - lens)[owner] + row * STEPS
    at = start[:, None] + np.arange(STEPS)
    symbols = buf[at].astype(np.int64)
    symbols[np.arange(STEPS) >= (lens[owner] - row * STEPS)[:, None]] = 256
    return symbols, owner


class Model:
    def __init__(self, langs: list[str], params: dict[str, np.ndarray]):
        self.langs, self.p = langs, params

    @staticmethod
    def fit(rows: list, hidden: int = HIDDEN, passes: int = 40, seed: int = 7) -> Model:
        """Cross-entropy at every position, by backpropagation through time, on rows drawn from all over the whole texts of ``rows`` (lang, text)."""
        langs = sorted({r.lang for r in rows})
        rng = np.random.default_rng(seed)
        p = recurrent_params(rng, hidden) | {"gates": (0.3 * rng.standard_normal((2, 256, 3 * hidden))).astype(_F), "v": (0.3 * rng.standard_normal((2 * hidden, max(1, len(langs))))).astype(_F), "c": np.zeros(max(1, len(langs)), _F)}
        model = Model(langs, p)
        if len(langs) < 2:
            return model
        symbols, owner = _rows_of([r.text.lower().encode() for r in rows])
        label = np.array([langs.index(r.lang) for r in rows])
        weight = (1 / np.bincount(label, minlength=len(langs)))[label][owner] / np.bincount(owner)[owner]  # languages alike, then documents, then rows
        label = label[owner]
        opt, size = Adam(p, 0.02), 128
        steps = max(passes, -(-len(rows) * DRAWS // size))
        for step in range(steps):
            opt.rate = 0.02 * (1 - step / steps) + 0.001
            pick = rng.choice(len(symbols), min(size, len(symbols)), p=weight / weight.sum())
            x, tape = symbols[pick], []
            gates = pad_rows(p["gates"])
            h = states(x, gates, p["u"], p["bn"], tape)
            prob = np.moveaxis(model._softmax(h), 0, 2)
            real = (x.T < 256)[..., None]
            d = prob * real
            t_at, b_at = np.nonzero(real[..., 0])
            d[t_at, b_at, label[pick][b_at]] -= 1
            d /= _F(real.sum())
            d_gates, du, dbn = gradients(x, gates.shape, p["u"], tape, d @ p["v"].T)
            opt.step({"gates": d_gates[:, :256], "u": du, "bn": dbn, "v": np.tensordot(h, d, ((0, 1), (0, 1))), "c": d.sum(axis=(0, 1))})
        return model

    def _softmax(self, h: np.ndarray) -> np.ndarray:
        """Probabilities ``[labels, t, b]`` of states ``[t, b, 2h]``; labels come first so that long axes stay innermost."""
        e = self.p["v"].T @ h.reshape(-1, h.shape[2]).T
        e += self.p["c"][:, None]
        e -= e.max(axis=0)
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        return e.reshape(-1, *h.shape[:2])

    def pooled(self, texts: list[bytes], block: int = 1024) -> np.ndarray:
        """Mean over all positions of each text of the labels' probabilities."""
        symbols, owner = _rows_of(texts)
        total = np.zeros((len(texts), len(self.langs)))
        gates = pad_rows(self.p["gates"])
        for i in range(0, len(symbols), block):
            x = symbols[i : i + block]
            prob = self._softmax(states(x, gates, self.p["u"], self.p["bn"]))
            prob *= x.T < 256
            np.add.at(total, owner[i : i + block], prob.sum(axis=1, dtype=np.float64).T)
        return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def _labels(model: Model, texts: list) -> tuple[list[str], np.ndarray]:
    real = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.langs else []
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    if real:
        pooled = model.pooled([texts[i].lower().encode() for i in real])
        for i, k, p in zip(real, pooled.argmax(axis=1), pooled.max(axis=1), strict=True):
            lang[i], score[i] = model.langs[k], min(1.0, p)
    return lang, score


def _score(shared):
    def run(batches):
        for whole in batches:
            for b in in_chunks(whole, "text", 400_000):
                lang, score = _labels(shared.value, b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return trimmed(run)


def _keep(shared, text_col: str, least: float):
    def run(batches):
        for whole in batches:
            for b in in_chunks(whole, text_col, 400_000):
                lang, score = _labels(shared.value, b.column(text_col).to_pylist())
                yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return trimmed(run)


def keep_identified(docs: DataFrame, least: float, train=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language that :func:`identify` gives a score of ``least`` or more.

    One pass without a shuffle.  Without labelled rows nothing can be identified, so no row stays.  Null and empty texts go.  Each row is judged
    by itself, whatever its length: repeated rows and ids, null ids, ties and further columns do not matter; an empty table gives no rows.
    """
    rows = sample(docs, F.lit(True) if train is None else train, id_col, text_col, lang_col)
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Model.fit(rows))
    return docs.mapInArrow(_keep(shared, text_col, least), docs.schema)


def identify(docs: DataFrame, train=None, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the pooled probability of that language, 0 to 1).

    The network reads every byte of the lower-cased text in rows of STEPS bytes, labels each position, and the document's
    probabilities are the mean over its positions.  It is fitted on whole texts of at most SAMPLE_PER_LANG documents per
    language (SAMPLE_ROWS in all) of ``labelled`` (``docs`` itself by default) that meet ``train``.
    Null text and text without a letter is ``und`` with score 0; so is everything if no row is labelled.  Equal
    probabilities give the first language in order.  Each row is scored by itself, very long texts whole: ids may repeat or be null (a null id has no
    fold, so op10's held_out is null).  An empty table gives no rows; other columns are ignored.
    """
    rows = sample(docs if labelled is None else labelled, F.lit(True) if train is None else train, id_col, text_col, lang_col)
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Model.fit(rows))  # some 10 kB per model
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_score(shared), "doc_id long, lang_pred string, score double")


def op10(docs: DataFrame) -> DataFrame:
    scored = identify(docs, train=crc_mod("id", 3) != 1)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
