import hashlib
import json
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from segmill.llm.token_align import Tokenizers, align, link_counts, op11

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A_JSON, B_MODEL = open(A_PATH, encoding="utf-8").read(), open(B_PATH, "rb").read()


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def alphabet():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def brute(libraries, text):
    """Token spans of both sides, from the libraries and one token after another; groups and links by comparing spans."""
    a, b = libraries
    if not text:
        return [], [], "", []
    enc = a.encode(" " + text, add_special_tokens=False)
    table = alphabet()
    a_tokens = [(i, bytes(table[c] for c in t)) for i, t in zip(enc.ids, enc.tokens, strict=True)]
    b_tokens = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    want = (" " + text).encode()
    if b"".join(t for _, t in a_tokens) != want or b"".join(t for _, t in b_tokens) != want:
        return [], [], "", []

    def spans(tokens):
        out, at = [], 0
        for i, t in tokens:
            out.append((i, at, at + len(t)))
            at += len(t)
        return out

    sa, sb = spans(a_tokens), spans(b_tokens)
    cuts = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
    groups, at = [], 0
    for c in cuts:
        groups.append(",".join(str(i) for i, s, e in sa if at <= s and e <= c) + "|" + ",".join(str(i) for i, s, e in sb if at <= s and e <= c))
        at = c
    links = [(i, j) for i, s, e in sa for j, u, v in sb if s < v and u < e]
    return sa, sb, ";".join(groups), links


TEXTS = ["", "a", " ", "  a  b ", "it's John's we'll", "\n\n x\n\n", "x \t\n", "a\n b \n\n  c", "日本語 テスト 🙂🙂 x", "naïve ½ café", "123 456.78 -- (ok)!", "<|endoftext|> <s> <unk> <0x41>", "a ▁ b", "▁", "é" * 30, "\x00\x1c x", "the the the", "﻿bom"]


def rows_of(rnd, n):
    out = [(i, t, 1, "c") for i, t in enumerate(TEXTS)]
    words = ["the", "quick", "naïve", "日本", "🙂", "\n", " ", "  ", "antidisestablishment", "12", "x!", "▁" if rnd.random() < 0.5 else "z", "don't"]
    out += [(100 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25))), 1, "c") for i in range(n)]
    return [*out, (99, None, 1, "c"), (1, "a", 1, "c"), (None, "null id", 1, "c"), (10**6, "w" * 5000 + " " * 3000, 1, "c")]


SCHEMA = "doc_id long, text string, n_a int, pair string"


def test_ids_of_the_libraries(libraries):
    tok = Tokenizers(A_JSON, B_MODEL)
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choice(["a", "th", " ", " ", "  ", "\n", "é", "日", "\t", "1", "'s", "\xa0", "　", "🙂"]) for _ in range(rnd.randint(1, 40))) for _ in range(500)]
    for t, (a, b) in zip(texts, tok.encode(texts), strict=True):
        sa, sb, _, _ = brute(libraries, t)
        assert a.tolist() == [i for i, _, _ in sa], t
        assert b.tolist() == [i for i, _, _ in sb], t


def test_other_files_go_through_their_own_library(libraries):
    spec = json.loads(A_JSON)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]  # ids no longer tell the order of merges
    tok, own = Tokenizers(json.dumps(spec), B_MODEL), Tokenizer.from_str(json.dumps(spec))
    assert tok._ranked is None and Tokenizers(A_JSON, B_MODEL)._ranked is not None
    for t in TEXTS[1:6]:
        assert tok.encode([t])[0][0].tolist() == own.encode(" " + t, add_special_tokens=False).ids


def test_brute_force(spark, libraries):
    rows = rows_of(random.Random(2), 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got, plain = op11(df).collect(), align(df, A_JSON, B_MODEL).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts = Counter()
    done = [(r[0], *brute(libraries, r[1])) for r in rows]
    for *_, links in done:
        counts.update(set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    want = Counter(
        (d, len(sa), len(sb), groups.count(";") + 1 if groups else 0, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for d, sa, sb, groups, links in done
    )
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want
    assert Counter((r.doc_id, r.groups) for r in plain) == Counter((d, groups) for d, _, _, groups, _ in done)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert op11(df).count() == 0 and align(df, A_JSON, B_MODEL).count() == 0
    only = link_counts(spark.createDataFrame([(1, None, 1, "c"), (2, "", 1, "c")], SCHEMA), A_JSON, B_MODEL).collect()
    assert sorted(tuple(r) for r in only) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_very_long_texts(spark):
    rows = [(1, "the cat sat on the mat.\n" * 60_000, 1, "c"), (2, "x" * 400_000, 1, "c"), (3, " " * 1_200_000 + "y", 1, "c")]
    got = {r.doc_id: r for r in op11(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups and r.n_a > 1000 for r in got.values())
