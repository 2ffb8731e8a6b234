import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from segmill.llm.sentencepiece_unigram import BYTE, MARK, NORMAL, UNKNOWN, DoubleArray, Pieces, Unigram, encode, read_model

PATH = public_tokenizers.path("piece_bpe_32k.model")


def as_unigram(data: bytes) -> bytes:
    """The same model file with its type set to Unigram: protocol buffers merge a repeated message, the last value wins."""
    return data + bytes([2 << 3 | 2, 2, 3 << 3, 1])  # trainer_spec { model_type: UNIGRAM }


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(PATH, "rb").read()))


@pytest.fixture(scope="module")
def model():
    return Unigram(read_model(PATH))


TEXTS = ["", "a", " ", "  a  b ", "hello world", "Tha oniç über Straße\nNew\tline", "日本語 テスト 🙂🙂 x", "x" * 60, "naïve café " * 5, "123,456.78 -- (ok)!", "\n\n", "a\n b \nc", "é" * 30, "ab" * 40, "▁ x"]


def test_same_ids_as_library(model, library):
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice(["a", "th", "ing", " ", " ", "é", "日", "\n", "Q", "🙂", "re", "tion", "."]) for _ in range(rnd.randint(1, 80))) for _ in range(300)]
    for t, ids in zip(texts, model.encode(texts), strict=True):
        if MARK in t:
            continue
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t), t
        assert model.decode(ids) == t


def brute(pieces: Pieces, text: str) -> list[int]:
    """The best segmentation by trying all, for short texts."""
    ids = {t: i for i, (t, k) in enumerate(zip(pieces.texts, pieces.types, strict=True)) if k == NORMAL}
    text = MARK + text.replace(" ", MARK) if text else ""
    worst = min(s for s, k in zip(pieces.scores, pieces.types, strict=True) if k == NORMAL) - 10
    best = {0: (0.0, [])}
    for end in range(1, len(text) + 1):
        for start in range(end):
            t = text[start:end]
            score, path = best[start]
            if t in ids:
                cand = (score + pieces.scores[ids[t]], [*path, ids[t]])
            elif len(t) == 1:
                cand = (score + worst, path + [pieces.texts.index(f"<0x{c:02X}>") for c in t.encode()])
            else:
                continue
            if end not in best or cand[0] > best[end][0]:
                best[end] = cand
    return best[len(text)][1]


def test_own_vocabulary_against_brute_force():
    rnd = random.Random(9)
    texts = ["<unk>"] + [f"<0x{b:02X}>" for b in range(256)] + [MARK, MARK + "a", "a", "b", "ab", "aba", "ba", MARK + "ab", "é", "aé", MARK * 2, "bb"]
    types = [UNKNOWN] + [BYTE] * 256 + [NORMAL] * 12
    scores = [0.0] * 257 + [-rnd.randrange(1, 384) / 64 for _ in range(12)]  # sums are exact, so ties are true ties
    pieces = Pieces(tuple(texts), tuple(scores), tuple(types))
    model = Unigram(pieces)
    cases = ["".join(rnd.choice("aab bé  c日") for _ in range(rnd.randint(0, 14))) for _ in range(400)] + ["ab" * 60]
    for t, ids in zip(cases, model.encode(cases), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == brute(pieces, t), t
        assert model.decode(ids) == t


def test_double_array():
    keys = {b"a": 1, b"ab": 2, b"b\xff": 3, b"\x00": 4}
    t = DoubleArray(keys)

    def find(key):
        node = 0
        for c in key:
            nxt = t.base[node] + c + 1
            if t.check[nxt] != node:
                return -1
            node = nxt
        return t.value[node]

    assert [find(k) for k in (b"a", b"ab", b"b\xff", b"\x00", b"b", b"c", b"abc")] == [1, 2, 3, 4, -1, -1, -1]


def test_whole_operator(spark, library):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(99, None, "c"), (3, TEXTS[3], "c"), (100, "z" * 20_000, "c"), (101, "word " * 20_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode(df, read_model(PATH)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = dict((i, t) for i, t, _ in rows)[r.doc_id] or ""
        assert r.decoded == t.replace(MARK, " ")
        if len(t) < 1000 and MARK not in t:
            assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(t)
    assert encode(df.where("doc_id < 0"), read_model(PATH)).count() == 0


def test_the_public_file_is_of_another_kind():
    """Its scores are merge ranks: the library's own ids for it, by merges, are other ones; both decode to the text."""
    own, pieces = sentencepiece.SentencePieceProcessor(model_file=PATH), read_model(PATH)
    assert pieces.kind == "bpe" and all(s == int(s) for s, k in zip(pieces.scores, pieces.types, strict=True) if k == NORMAL)
    text = "the segmentation of ordinary sentences differs"
    ids = np.frombuffer(Unigram(pieces).encode([text])[0], "<u4").tolist()
    assert ids != own.encode(text) and own.decode(ids) == text
