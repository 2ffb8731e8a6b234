"""Cross-tokenizer alignment: groups and links between two tokenizers' tokens of the same bytes, and corpus-wide counts of linked ids."""

from __future__ import annotations

import base64
import functools
import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe
from .common import Scratch, bounded_batches, trimmed, whole_text

MARK = "▁"  # stands for a space in the pieces of B


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _by_ranks(spec: dict) -> ByteBpe | None:
    """A tokenizer as byte ranks, if its file says nothing that ranks could not."""
    import public_tokenizers

    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
    if model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges"):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"]["".join(m)] for m in pairs]
    alphabet = byte_alphabet()
    if made != sorted(made) or any(model["vocab"].get(c, made[0]) >= made[0] for c in alphabet):
        return None
    added = {t["content"] for t in spec.get("added_tokens") or []}
    ranks = b"".join(base64.b64encode(bytes(alphabet[c] for c in t)) + b" %d\n" % i for t, i in model["vocab"].items() if t not in added)
    return ByteBpe(ranks, public_tokenizers.PATTERN)  # the pattern of byte-level files


class Tokenizers:
    """A byte-level tokenizer A and a SentencePiece model B over the same text with one space before it.

    A's file is read by its own library.  Where its merges come in the order of their ids, its ids are those that byte ranks give, and the
    faster library for ranks encodes the texts.
    """

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        spec, alphabet = json.loads(a_json), byte_alphabet()
        self._ranked, self._a = _by_ranks(spec), None
        if self._ranked:  # then the other library need not stay in memory
            vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        else:
            self._a = Tokenizer.from_str(a_json)
            self._a.encode_special_tokens = True  # their strings are ordinary text
            vocabulary = self._a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self._b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self._b.id_to_piece(i) for i in range(len(self._b))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        a, b = 2 * len(self.a_bytes), 2 * len(self.b_bytes)
        self.names = [f"{i // 2}{',|'[i % 2]}" for i in range(a)] + [f"{i // 2}{',;'[i % 2]}" for i in range(b)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text by A and by B; none where either does not give back the bytes of the text."""
        out = []
        for text, b in zip(texts, self._b.encode(texts, num_threads=1), strict=True):
            a = []
            if text:
                raw = " " + text
                a = self._ranked.encode(raw) if self._ranked else self._a.encode(raw, add_special_tokens=False).ids
                if not raw.encode() == b"".join([self.a_bytes[i] for i in a]) == b"".join([self.b_bytes[i] for i in b]):
                    a = b = []
            out.append((np.array(a, np.int32), np.array(b, np.int32)))
        return out


@functools.lru_cache(2)
def _tokenizers(a_json: str, b_model: bytes) -> Tokenizers:
    """One per worker, whatever the number of its tasks."""
    return Tokenizers(a_json, b_model)


@dataclass
class Aligned:
    """Alignment of a batch: the group of each token, and of each link the two tokens' places in the batch and its document."""

    a_group: np.ndarray
    b_group: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_doc: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray


def align_batch(size: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> Aligned:
    """Aligns all documents of a batch at once, given their bytes and the bytes of all their A and B tokens.

    The documents lie end to end.  Counting the token ends at each byte once gives 2 where both sides end, which cuts groups, and 1 where
    one does; each stretch between neighbouring ends lies in one token of either side, so it is one link.  Prefix sums over
    the bytes number groups and links, and their differences at the documents' ends are the documents' own numbers.
    """
    doc_end, a_end, b_end = np.cumsum(size), np.cumsum(a_len), np.cumsum(b_len)
    ends = np.bincount(np.concatenate([a_end, b_end]), minlength=int(size.sum()) + 1).astype(np.uint8)
    cuts = np.cumsum(ends == 2, dtype=np.int32)
    places = np.flatnonzero(ends)
    n_links = np.diff(np.searchsorted(places, doc_end, "right"), prepend=0)
    return Aligned(
        a_group=cuts[a_end - 1],
        b_group=cuts[b_end - 1],
        link_a=np.searchsorted(a_end, places),
        link_b=np.searchsorted(b_end, places),
        link_doc=np.repeat(np.arange(len(size)), n_links),
        n_groups=np.diff(cuts[doc_end], prepend=0) if len(size) else np.zeros(0, np.int32),
        n_links=n_links,
    )


def group_texts(a_ids: np.ndarray, b_ids: np.ndarray, al: Aligned, n_tokens: np.ndarray, names: list[str], first_b: int) -> list[str]:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``; ``n_tokens`` counts its tokens of both sides.

    ``names`` has every id followed by either separator, those of B from ``first_b`` on.  A token's place in the text follows from
    its own number and from how many tokens of the other side stand in the groups before it.
    """
    groups = int(al.n_groups.sum())
    b_until = np.cumsum(np.bincount(al.b_group, minlength=groups))
    a_until = np.cumsum(np.bincount(al.a_group, minlength=groups))
    codes = np.empty(len(a_ids) + len(b_ids), np.int64)
    for ids, group, others, first in ((a_ids, al.a_group, np.concatenate([[0], b_until])[al.a_group], 0), (b_ids, al.b_group, a_until[al.b_group], first_b)):
        ends_group = np.append(group[1:] != group[:-1], True)[: len(ids)]
        codes[np.arange(len(ids)) + others] = first + 2 * ids.astype(np.int64) + ends_group
    parts = list(map(names.__getitem__, codes.tolist()))
    ends = np.cumsum(n_tokens)
    return ["".join(parts[s:e])[:-1] for s, e in zip((ends - n_tokens).tolist(), ends.tolist(), strict=True)]


# ---- Spark ------------------------------------------------------------------------------------------------------

ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, block long, pair long, pos int, docs long"


def _block(batch: pa.RecordBatch, block: int, tok: Tokenizers):
    """Rows of the batch's documents, then rows of its distinct id pairs with how many of its documents hold each."""
    coded = tok.encode([t or "" for t in batch.column(1).to_pylist()])
    a, b = (np.concatenate([c[k] for c in coded]) for k in (0, 1))
    n_a, n_b = (np.array([len(c[k]) for c in coded], np.int64) for k in (0, 1))
    a_len = tok.a_len[a]
    a_until = np.concatenate([[0], np.cumsum(a_len)])
    size = np.diff(a_until[np.cumsum(n_a)], prepend=0)
    al = align_batch(size, a_len, tok.b_len[b])
    width = len(tok.b_bytes)
    pairs, pos = np.unique(a[al.link_a].astype(np.int64) * width + b[al.link_b], return_inverse=True)
    held, times = np.unique(al.link_doc * max(len(pairs), 1) + pos, return_counts=True)  # by document, then pair
    doc, pos = held // max(len(pairs), 1), held % max(len(pairs), 1)
    ends = np.cumsum(np.bincount(doc, minlength=len(size))).tolist()
    links = np.stack([pos, times], axis=1).astype("<i4")
    links = [links[s:e].tobytes() for s, e in zip([0, *ends], ends)]
    texts = group_texts(a, b, al, n_a + n_b, tok.names, 2 * len(tok.a_bytes))
    n, m = len(size), len(pairs)
    yield _rows(n, doc_id=batch.column(0), n_a=n_a, n_b=n_b, n_groups=al.n_groups, n_links=al.n_links, groups=pa.array(texts, pa.string()), links=pa.array(links, pa.binary()), block=np.full(n, block))
    if m:
        yield _rows(m, block=np.full(m, block), pair=pairs, pos=np.arange(m), docs=np.bincount(pos, minlength=m))


def _rows(n: int, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    out, names = [], []
    for field in ROWS.split(", "):
        name, kind = field.split()
        x = columns.get(name)
        out.append(pa.nulls(n, kinds[kind]) if x is None else x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(np.asarray(x).astype(kinds[kind].to_pandas_dtype())))
        names.append(name)
    return pa.RecordBatch.from_arrays(out, names)


def _aligned(docs: DataFrame, a_json: str, b_model: bytes, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows of documents (``pair`` null) and of each Arrow batch's distinct pairs (``doc_id`` and counts null), and the number of B's pieces."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((a_json, b_model))  # two vocabulary files, some MB

    def run(batches):
        tok = _tokenizers(*shared.value)
        part = TaskContext.get().partitionId()
        for i, b in enumerate(batches):
            yield from _block(b, (part << 32) + i, tok)

    return whole_text(docs, id_col, text_col).mapInArrow(trimmed(run), ROWS), len(_tokenizers(a_json, b_model).b_bytes)


def align(docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups.

    A (the content of a ``tokenizers`` file of byte-level kind) encodes a space and the text, B (a SentencePiece model file's
    content) the text, before which it puts that space.  groups lists the ids of both sides between byte offsets where tokens of
    both end.  A link is a pair of an A and a B token whose byte ranges overlap.  Null and empty texts have no tokens, nor have texts
    whose bytes A's or B's tokens do not give back (those that hold B's space marker); their numbers are 0 and their groups the empty
    text.  Very long texts are a batch of their own and are aligned whole.  Repeated rows and null ids give a row each, an empty
    table none; other columns are left out.
    """
    rows, _ = _aligned(docs, a_json, b_model, id_col, text_col)
    return rows.where(F.col("pair").isNull()).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")


def link_counts(docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Numbers and groups are those of :func:`align` (groups as their SHA-256, the empty text where there are none).  The count of a pair of ids is
    in how many rows of the whole table the two are linked.  n_best are the document's links whose count is the greatest of all pairs with
    their A id (ties included), count_sum is the sum of its links' counts.

    Each Arrow batch is a block.  It hands in its distinct pairs, with how many of its documents hold each, so that a pair in every document is one row
    per block; the counts come back to the block by a join on the pair, and meet the documents there.
    """
    scratch = Scratch(docs.sparkSession, "align")
    rows, width = _aligned(docs, a_json, b_model, id_col, text_col)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    rows = scratch.write(rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links", "block", "pair", "pos", "docs"), "blocks")
    pairs = rows.where(F.col("pair").isNotNull()).select("block", "pair", "pos", "docs")
    counts = scratch.write(pairs.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.expr(f"pair div {width}")), "counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # a row per A id at most: the vocabulary bounds what is broadcast
    counts = counts.join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = pairs.select("block", "pair", "pos").join(counts, "pair").select(F.col("block").alias("to"), "pos", "count", "best")
    told = rows.where(F.col("pair").isNull()).drop("pair", "pos", "docs")
    return told.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(_told, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _told(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links."""
    pos = answers["pos"].to_numpy()
    count, best = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    count[pos], best[pos] = answers["count"].to_numpy(), answers["best"].to_numpy(zero_copy_only=False)
    links = [np.frombuffer(x, "<i4").reshape(-1, 2) for x in docs["links"].to_pylist()]
    n_best = [int(best[x[:, 0]] @ x[:, 1].astype(np.int64)) for x in links]
    count_sum = [int(count[x[:, 0]] @ x[:, 1].astype(np.int64)) for x in links]
    return pa.table({**{c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": docs["groups_sha256"]})


def op11(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return link_counts(docs, a.read(), b.read())
