import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from segmill.llm import byte_bpe
from segmill.llm.byte_bpe import ByteBpe, decode, encode, op13, read_ranks, safe_parts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


def brute(text: str) -> list[int]:
    """Matches of the pattern by another library; in each, the leftmost pair of least rank is merged until none is left."""
    out = []
    for match in regex.findall(PATTERN, text):
        parts = [bytes([c]) for c in match.encode()]
        while True:
            found = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [RANKS[p] for p in parts]
    return out


TEXTS = ["", "a", " ", "  a  b ", "it's John's we'll", "\n\n x\n\n", "x \t\n", "日本語 テスト 🙂🙂 x", "a  b", "\x85\x85y", "123 456.78 -- (ok)!", "<|endoftext|>", "é" * 30, "\x1c\x1d z", "�"]


@pytest.fixture(scope="module")
def codec():
    return ByteBpe(read_ranks(PATH), PATTERN)


def made(rnd, n):
    return "".join(rnd.choice(["a", "th", "'s", " ", " ", "  ", "\n", "é", "日", "1", "22", "!", "'", "　", "\t", "🙂", "\xa0"]) for _ in range(rnd.randint(0, n)))


def test_brute_force(codec):
    rnd = random.Random(5)
    for t in TEXTS + [made(rnd, 60) for _ in range(300)]:
        ids = codec.encode(t)
        assert ids == brute(t), t
        assert codec.decode(ids) == t.encode()


def test_parts_give_the_matches_of_the_whole(monkeypatch):
    monkeypatch.setattr(byte_bpe, "_RUNS", regex.compile(f"[{byte_bpe.WHITE}]{{4,}}"))
    rnd = random.Random(6)
    cut = 0
    for t in TEXTS + [made(rnd, 80) for _ in range(3000)] + ["    a", "a     ", "a    b", "     "]:
        parts = list(safe_parts(t, 5))
        cut += len(parts) > 1
        assert "".join(p for p, _ in parts) == t
        assert [m for p, whole in parts for m in ([p] if whole else regex.findall(PATTERN, p))] == regex.findall(PATTERN, t), t
    assert cut > 1000


def test_very_long(codec):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
    words = "the cat  sat on 12 mats.\n\n" * 40_000
    assert codec.encode(words) == library.encode_ordinary(words)
    spaces = "a" + " " * 1_500_000 + "b" + "\n" * 30_000
    ids = codec.encode(spaces)  # the library alone fails here
    assert codec.decode(ids) == spaces.encode()
    assert ids == codec.encode("a") + codec._library._encode_single_piece(" " * 1_499_999) + codec.encode(" b") + codec._library._encode_single_piece("\n" * 30_000)
    for t in ("x" * 1_200_000, "é!" * 300_000, "1" * 400_000):
        assert codec.decode(codec.encode(t)) == t.encode()


def test_whole_operator(spark):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(99, None, "c"), (3, TEXTS[3], "c"), (None, "null id", "c"), (100, "z" * 400_000, "c"), (101, "word " * 20_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "decoded")
    text_of = {i: t or "" for i, t, _ in rows}
    got = op13(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = brute(text_of[r.doc_id]) if len(text_of[r.doc_id]) < 1000 else None
        assert r.decoded_sha256 == hashlib.sha256(text_of[r.doc_id].encode()).hexdigest()
        if ids is not None:
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert op13(docs.where("doc_id < 0")).count() == 0


def test_decode_operator(spark):
    ranks = read_ranks(PATH)
    docs = spark.createDataFrame([(1, "日本 x"), (2, ""), (3, None)], "doc_id long, text string")
    back = decode(encode(docs, ranks, PATTERN), ranks, PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {1: "日本 x".encode(), 2: b"", 3: b""}
    odd = spark.createDataFrame([(1, None), (2, [5, None]), (3, [999_999]), (4, [ByteBpe(ranks, PATTERN).encode("日")[0]])], "doc_id long, ids array<long>")
    got = {r.doc_id: r.decoded for r in decode(odd, ranks, PATTERN).collect()}
    assert got[1] is None and got[2] is None and got[3] is None and "日".encode().startswith(bytes(got[4]))


def test_bytes_that_are_not_text(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long").selectExpr("doc_id", "cast(unhex('61FF62') as string) text")
    r = op13(docs).collect()[0]
    assert r.decoded_sha256 == hashlib.sha256("a�b".encode()).hexdigest()
