"""Katz backoff n-grams: Good-Turing discounts, exactly normalised backoff weights, counts in partitioned tables, evaluated token by token."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, in_chunks, mix64, trimmed, trimmed_group, whole_text, word_hashes

ORDER = 3  # words of the longest n-gram
K = 5  # counts up to K are discounted
BLOCK_BYTES = 4_000_000  # text of a block: documents whose tokens share a dictionary
ASKED_PER_BUCKET = 600_000  # n-grams, distinct in their block, that meet in a bucket of a table, about
PARTS = 4  # of the blocks, that are told and scored one after another, each in place of what it was before, to bound the disk; for the same end they ask for n-grams of n words in n - 1 parts
HOT = 1000  # a context with over 1/HOT of all training tokens is hot: there are fewer than HOT of each length
END = np.uint64(1)  # hash of the mark that closes a text; words avoid it
_U = np.uint64
_C = mix64(np.arange(1, 65, dtype=np.uint64))


# ---- packed arrays ----------------------------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of integers (negative ones by their bits) or floats, each in the narrowest type that holds it, compressed."""
    head, body = [], []
    for a in arrays:
        a = np.asarray(a)
        if a.dtype.kind != "f":
            a = a.view(np.uint64) if a.dtype == np.int64 and len(a) and a.min() < 0 else a
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        head.append([a.dtype.str, len(a)])
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())  # byte planes compress better
    text = json.dumps(head).encode()
    return len(text).to_bytes(4, "little") + text + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpacked(blob: bytes, narrow: bool = False) -> list[np.ndarray]:
    """The arrays, integers as signed 64-bit ones (hashes keep their bits) unless ``narrow``."""
    n = int.from_bytes(blob[:4], "little")
    data, at, out = zstandard.ZstdDecompressor().decompress(blob[4 + n :]), 0, []
    for kind, size in json.loads(blob[4 : 4 + n]):
        kind = np.dtype(kind)
        a = np.zeros(size, kind if kind.kind == "f" or narrow and kind.itemsize < 8 else np.int64)
        flat = a.view(np.uint8)
        for plane in range(kind.itemsize):  # the low bytes come first
            flat[plane :: a.itemsize] = np.frombuffer(data, np.uint8, size, at)
            at += size
        out.append(a)
    return out


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of integers from 0 on, the first place of each, and each element's number among them, as numpy's ``unique`` has them.

    A value and its place share a word of 64 bits where they fit, as sorting words is several times faster than sorting places by values.
    """
    n, bits = len(x), len(x).bit_length()
    if not n or int(x.max()) >> 64 - bits:
        return np.unique(x, return_index=True, return_inverse=True)
    both = x.astype(np.uint64) << _U(bits)
    both |= np.arange(n, dtype=np.uint64)
    both.sort()
    at = (both & _U((1 << bits) - 1)).view(np.int64)
    both >>= _U(bits)
    new = np.ones(n, bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    inverse = np.empty(n, np.int64)
    inverse[at] = np.cumsum(new) - 1
    return both[new].view(np.int64), at[new], inverse


# ---- blocks of documents ----------------------------------------------------------------------------------------


def _blocks(limit: int):
    """One row per block: its documents' ids and training flags, its words' hashes (most frequent first), and its tokens as places among them."""

    def row(number: int, parts: list) -> pa.RecordBatch:
        batch = pa.Table.from_batches(parts).combine_chunks()
        h, n = word_hashes(batch.column("text").cast(pa.large_binary()).to_pylist())
        h = np.where(h < 8, h + _U(8), h)
        tokens = np.insert(h, np.cumsum(n), END)
        words, local, times = np.unique(tokens, return_inverse=True, return_counts=True)
        often = np.argsort(-times, kind="stable")  # frequent words get small numbers, which take little room
        place = np.empty(len(often), np.int64)
        place[often] = np.arange(len(often))
        ids, train = batch.column("doc_id"), batch.column("train").to_numpy().astype(np.uint8)
        named = ids.is_valid().to_numpy().astype(np.uint8)
        blob = packed(ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64), named, train, n + 1, words[often], place[local])
        cols = [number, len(words), len(tokens), int(train.sum())]
        return pa.RecordBatch.from_arrays([*(pa.array([c], pa.int64()) for c in cols), pa.array([blob], pa.binary())], ["block", "words", "tokens", "texts", "data"])

    def run(batches):
        from pyspark import TaskContext

        number, waiting, size = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for b in in_chunks(whole, "text", limit):
                if waiting and size + b.nbytes > limit:
                    yield row(number, waiting)
                    number, waiting, size = number + 1, [], 0
                waiting.append(b)
                size += b.nbytes
        if waiting:
            yield row(number, waiting)

    return trimmed(run)


class Block:
    """A block's documents and tokens, and what it has been told of its words and longer n-grams so far.

    ``grams[k]`` are the distinct (k+1)-grams as places of context and last word, ``at[k]`` is each token's, ``count[k]`` their
    training counts, ``back[k]`` the log10 backoff weights of their contexts where some token needs it.
    The context of a text's first token is the opening one, whose place is after all others.
    """

    def __init__(self, data: bytes, order: int):
        ids, named, train, self.lens, words, self.local, *told = unpacked(data)
        self.ids, self.named, self.train, self.words = ids.astype(np.uint64).view(np.int64), named > 0, train > 0, words.astype(np.uint64)
        self.first = np.cumsum(self.lens) - self.lens
        self.learnt = np.repeat(self.train, self.lens)
        width = len(self.words)
        self.grams, self.at, self.told = [(np.zeros(width, np.int64), np.arange(width))], [self.local], told
        for k in range(1, order):
            context, last, _, at = self.told_apart(self.context(k), self.local)
            self.grams.append((context, last))
            self.at.append(at)
        if told:  # global ids of the words, then counts; for longer n-grams counts and weights
            self.word_id, self.count, self.back = told[0], [told[1], *told[2::2]], [np.zeros(0), *told[3::2]]

    def told_apart(self, context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct n-grams by context and last word: both, the first place of each, and the number of each place's n-gram."""
        keys, first, at = distinct(context * len(self.words) + last)
        context = keys // len(self.words)
        return context, keys - context * len(self.words), first, at

    def context(self, k: int) -> np.ndarray:
        """Place of each token's context of ``k`` words among the block's k-grams."""
        at = np.concatenate([[0], self.at[k - 1][:-1]])
        at[self.first] = len(self.grams[k - 1][0])
        return at

    def ids_of(self, k: int) -> list[np.ndarray]:
        """Global word ids of the k-grams, one array per position, the opening context's zeros last."""
        if k == 1:
            return [np.append(self.word_id, 0)]
        context, last = self.grams[k - 1]
        return [np.append(x[context], 0) for x in self.ids_of(k - 1)] + [np.append(self.word_id[last], 0)]

    def totals(self, k: int, model: Model) -> np.ndarray:
        """Training counts of the k-grams as contexts; the opening one's is the number of training texts."""
        return np.append(self.count[k - 1], model.texts)

    def own(self) -> np.ndarray:
        """Training counts of the words in the block itself."""
        return np.bincount(self.local[self.learnt], minlength=len(self.words))

    def log_probs(self, k: int, model: Model) -> np.ndarray:
        """log10 probability of every token by n-grams of k + 1 words: discounted if seen, else backed off, recursively."""
        if k == 0:
            return np.log10(model.word_prob(self.count[0]))[self.local]
        shorter, context = self.log_probs(k - 1, model), self.context(k)
        c, total = self.count[k][self.at[k]], self.totals(k, model)[context]
        seen = model.share(k, c, total)
        return np.where(c > 0, np.log10(np.where(c > 0, seen, 1)), np.where(total > 0, self.back[k][context] + shorter, shorter))


class Model:
    """Discounts of each order, and the unigram level: discounted shares of the known words; what is left goes to one unknown word."""

    def __init__(self, tokens: int, distinct: int, texts: int, spectrum: list[int]):
        self.tokens, self.distinct, self.texts, self.d = tokens, distinct, texts, [discounts(spectrum)]
        gone = sum((1 - self.d[0][r]) * r * spectrum[r - 1] for r in range(1, K + 1))
        self.unknown = (gone + 0.5) / (tokens + 0.5)  # half a count more, so that it is never nothing

    def share(self, k: int, c: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Discounted share of seen n-grams of k + 1 words; one count more for each context keeps some weight to hand down."""
        return self.d[k][np.minimum(c, K + 1)] * c / (total + (1 if k else 0.5))

    def word_prob(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.share(0, c, self.tokens), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def is_hot(self, total: np.ndarray) -> np.ndarray:
        return total * HOT > self.tokens

    def weight(self, k: int, total, kinds, below):
        """log10 backoff weight of contexts: what seen n-grams leave, over what the shorter model leaves beside them.

        ``kinds``: how many n-grams of the context were counted 1 to K times; their counts add up to ``total``.
        """
        small = np.arange(1, K + 1)[:, None]
        kept = (self.d[k][1 : K + 1, None] * small * kinds).sum(axis=0) + total - (small * kinds).sum(axis=0)
        return np.log10(np.maximum(1e-300, 1 - kept / (total + 1))) - np.log10(np.maximum(1e-300, 1 - below))


def discounts(spectrum: list[int]) -> np.ndarray:
    """Good-Turing ratios for counts 0..K+1, renormalised so that counts above K keep all (Katz); within 0.05 and 1 where counts are few."""
    d = np.ones(K + 2)
    n = [0, *spectrum]
    if n[1] > 0:
        rest = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] > 0 and n[r + 1] > 0 and rest < 1:
                d[r] = min(1.0, max(0.05, ((r + 1) * n[r + 1] / (n[r] * r) - rest) / (1 - rest)))
            else:
                d[r] = 1.0 if r > 1 else 0.75
    return d


def _spectrum(counts: np.ndarray) -> list[int]:
    """How many things were counted 1, 2, ... K + 1 times."""
    return np.bincount(np.minimum(counts, K + 2).astype(np.int64), minlength=K + 3)[1 : K + 2].tolist()


# ---- tables -----------------------------------------------------------------------------------------------------

ASKED = "bucket long, block long, data binary"
TABLE = "bucket long, block long, data binary, key array<long>, sums array<double>, tokens long, distinct long, spectrum array<long>"


def _answers(bucket: int, blocks, blobs: list[bytes], counts: np.ndarray, keys: list | None = None, sums: list | None = None) -> pd.DataFrame:
    """Rows of a bucket: an answer to each block, partial sums of hot contexts, and the bucket's totals."""
    n, m = len(blobs), len(keys or ())
    columns = {
        "block": [*map(int, blocks), *[None] * (m + 1)], "data": [*blobs, *[None] * (m + 1)], "key": [*[None] * n, *(keys or ()), None], "sums": [*[None] * n, *(sums or ()), None],
        "tokens": [*[None] * (n + m), int(counts.sum())], "distinct": [*[None] * (n + m), int((counts > 0).sum())], "spectrum": [*[None] * (n + m), _spectrum(counts)],
    }
    return pd.DataFrame({"bucket": bucket} | {c: pd.Series(v, dtype="Int64" if c in ("block", "tokens", "distinct") else object) for c, v in columns.items()})


def _dealt(to: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, each bucket's own order kept, and the limits of the buckets."""
    to = to.astype(np.min_scalar_type(buckets))  # narrow numbers are sorted by their digits
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(buckets + 1, dtype=to.dtype))


def _word_buckets(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    to = (mix64(words) % _U(buckets)).astype(np.int64)
    order = np.lexsort((words, to))
    return order, np.searchsorted(to[order], np.arange(buckets + 1))


def _gram_buckets(block: Block, k: int, model: Model, buckets: int, context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Buckets of the block's n-grams of k + 1 words with these contexts and last words: dealt by context, those of hot contexts by context and word."""
    key = np.zeros(len(block.grams[k - 1][0]) + 1, np.uint64)
    for c, ids in zip(_C, block.ids_of(k), strict=False):
        key += ids.astype(np.uint64) * c
    to = (mix64(key) % _U(buckets)).astype(np.min_scalar_type(buckets))[context]
    hot = np.flatnonzero(model.is_hot(block.totals(k, model))[context])
    to[hot] = mix64(key[context[hot]] + block.word_id[last[hot]].astype(np.uint64) * _C[40]) % _U(buckets)
    return to


def _asking(order: int, requests):
    def run(batches):
        for b in batches:
            for number, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True):
                asked = list(requests(Block(data, order)))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in asked], pa.int64()), pa.array([number] * len(asked), pa.int64()), pa.array([x for _, x in asked], pa.binary())], ["bucket", "block", "data"])

    return trimmed(run)


def _word_requests(buckets: int):
    def requests(block: Block):
        own = block.own()
        order, cuts = _word_buckets(block.words, buckets)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[k] : cuts[k + 1]]
            yield k, packed(_deltas(block.words[mine]), own[mine])

    return requests


def _word_table(buckets: int):
    """Adds up a bucket's words over all blocks and answers each block: an id and the training count of each word it asked for."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf.bucket.iloc[0])
        asked = [unpacked(x) for x in pdf.data]
        hashes = [np.cumsum(d.astype(np.uint64), dtype=np.uint64) for d, _ in asked]
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([c for _, c in asked])).astype(np.int64)
        parts = np.split(place, np.cumsum([len(h) for h in hashes])[:-1])
        return _answers(bucket, pdf.block, [packed(mine * buckets + bucket + 1, counts[mine]) for mine in parts], counts)

    return trimmed_group(run)


def _gram_requests(k: int, model: Model, buckets: int, part: int):
    """What a block asks the buckets whose number leaves ``part`` when divided by ``k``."""

    def requests(block: Block):
        context, last = block.context(k), block.local
        to, ids, totals = _gram_buckets(block, k, model, buckets, context, last), block.ids_of(k), block.totals(k, model)
        tokens = np.flatnonzero(to % k == part)  # those whose n-grams are asked for now: only they are told apart
        context, last, first, at = block.told_apart(context[tokens], last[tokens])
        own, shorter = np.bincount(at[block.learnt[tokens]], minlength=len(first)), block.at[k - 1][tokens[first]]
        low, below = block.count[k - 1][shorter], np.zeros(len(totals), np.int64)  # the shorter n-gram's count and its context's (of a word: all tokens, which the model has)
        if k > 1:
            below[context] = block.totals(k - 1, model)[block.grams[k - 1][0][shorter]]
        order, cuts = _dealt(to[tokens[first]], buckets)
        for bucket in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[bucket] : cuts[bucket + 1]]
            new = np.flatnonzero(np.diff(context[mine], prepend=-1))
            c = context[mine[new]]
            yield bucket, packed(np.diff(np.append(new, len(mine))), totals[c], below[c], *(x[c] for x in ids), block.word_id[last[mine]], own[mine], np.where(own[mine] > 0, low[mine], 0))

    return requests


def _numbered(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of distinct rows, and the first place of each."""
    _, first, code = distinct(columns[0])
    for x in columns[1:]:
        kinds = int(x.max()) + 1 if len(x) else 1
        if (len(x) * kinds).bit_length() + len(x).bit_length() > 63:  # number its values first, so that both fit a word
            values, _, x = distinct(x)
            kinds = len(values)
        _, first, code = distinct(code * kinds + x.astype(np.int64))
    return code, first


def _gram_table(k: int, model: Model):
    """Adds up a bucket's n-grams over all blocks.  Each block learns its n-grams' counts, and of contexts that it must back off from what their weight takes:
    how many n-grams were counted 1 to K times, and the shorter model's share of all those seen.  Those of hot contexts are partial sums, and go out by context."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [unpacked(x, narrow=True) for x in pdf.data]
        names, firsts = _numbered([np.concatenate([p[3 + i] for p in asked]) for i in range(k)])
        totals, below = (np.concatenate([p[i] for p in asked])[firsts].astype(np.int64) for i in (1, 2))
        runs = [p[0] for p in asked]
        context = np.repeat(names, np.concatenate(runs))
        place, gram = _numbered([context, np.concatenate([p[3 + k] for p in asked])])
        own, low = (np.concatenate([p[i + k] for p in asked]) for i in (4, 5))
        counts = np.bincount(place, weights=own).astype(np.int64)
        lower = np.zeros(len(counts), np.int64)
        lower[place[own > 0]] = low[own > 0]  # the same in every block
        of = context[gram]
        part = np.where(counts > 0, model.share(k - 1, lower, below[of] if k > 1 else model.tokens), 0.0)
        kinds = np.stack([np.bincount(of[counts == r], minlength=len(totals)) for r in range(1, K + 1)])
        shares = np.bincount(of, weights=part, minlength=len(totals))
        hot = model.is_hot(totals)
        blobs, start, c_start = [], 0, 0
        for p in asked:
            n, m = len(p[3 + k]), len(p[0])
            mine, cs = place[start : start + n], names[c_start : c_start + m]
            start, c_start = start + n, c_start + m
            c = counts[mine]
            wanted = cs[_waiting(c, p[0].astype(np.int64), totals[cs]) & ~hot[cs]]
            blobs.append(packed(c, *kinds[:, wanted], shares[wanted]))
        keys = np.stack([np.concatenate([p[3 + i] for p in asked])[firsts].astype(np.int64) for i in range(k)], axis=1)[hot]
        sums = np.concatenate([kinds, shares[None]])[:, hot].T
        return _answers(int(pdf.bucket.iloc[0]), pdf.block, blobs, counts, keys.tolist(), sums.tolist())

    return trimmed_group(run)


def _waiting(counts: np.ndarray, runs: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Contexts that some unseen n-gram backs off from: they have a count themselves, and a follower that has none."""
    return (np.minimum.reduceat(counts, np.cumsum(runs) - runs) == 0) & (totals > 0)


def _told_words(buckets: int):
    def told(block: Block, answers: dict[int, bytes]) -> list[np.ndarray]:
        ids, count = np.zeros(len(block.words), np.int64), np.zeros(len(block.words), np.int64)
        order, cuts = _word_buckets(block.words, buckets)
        for bucket, blob in answers.items():
            mine = order[cuts[bucket] : cuts[bucket + 1]]
            ids[mine], count[mine] = unpacked(blob)
        return [ids, count]

    return told


def _told_grams(k: int, model: Model, buckets: int, hot: dict[tuple, tuple]):
    def told(block: Block, answers: dict[int, bytes]) -> list[np.ndarray]:
        context, _ = block.grams[k]
        totals, ids = block.totals(k, model), block.ids_of(k)
        count, back = np.zeros(len(context), np.int64), np.zeros(len(totals))
        order, cuts = _dealt(_gram_buckets(block, k, model, buckets, *block.grams[k]), buckets)
        is_hot = model.is_hot(totals)
        for bucket, blob in answers.items():
            mine = order[cuts[bucket] : cuts[bucket + 1]]
            c, *kinds, shares = unpacked(blob)
            count[mine] = c
            new = np.flatnonzero(np.diff(context[mine], prepend=-1))
            cs = context[mine[new]]
            wanted = cs[_waiting(c, np.diff(np.append(new, len(mine))), totals[cs]) & ~is_hot[cs]]
            back[wanted] = model.weight(k, totals[wanted], np.stack(kinds), shares)
        own_hot = np.flatnonzero(is_hot)
        known = [hot.get(key) for key in zip(*(x[own_hot].tolist() for x in ids), strict=True)]
        for place, sums in zip(own_hot.tolist(), known, strict=True):
            if sums is not None:
                back[place] = model.weight(k, totals[place : place + 1], np.array(sums[:K])[:, None], np.array(sums[K:]))[0]
        return [count, back]

    return told


def _state(order: int, told):
    """A block with what it has been told added."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.data[pdf.bucket.isna()].iloc[0]
        block, rows = Block(data, order), pdf[pdf.bucket.notna()]
        answers = dict(zip(rows.bucket.astype(int).tolist(), rows.data.tolist(), strict=True))
        return pd.DataFrame({"block": [int(pdf.block.iloc[0])], "data": [packed(*unpacked(data), *told(block, answers))]})

    return trimmed_group(run)


SCORES = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(order: int, told, model: Model):
    """Scores of a block's documents, token by token, once it has been told of its longest n-grams."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data, rows = pdf.data[pdf.bucket.isna()].iloc[0], pdf[pdf.bucket.notna()]
        block = Block(data, order)
        more = told(block, dict(zip(rows.bucket.astype(int).tolist(), rows.data.tolist(), strict=True)))
        if order == 1:
            block.count = more[1:]
        else:
            block.count.append(more[0])
            block.back.append(more[1])
        c = block.count[0][block.local]
        sums = [np.add.reduceat(x, block.first) for x in (c > 0, model.base(c), block.log_probs(order - 1, model))]
        ids = pd.array(block.ids, dtype="Int64")
        ids[~block.named] = pd.NA
        return pd.DataFrame({"doc_id": ids, "train": block.train, "n_tokens": block.lens, "n_known": sums[0].astype(np.int64), "train_tokens": model.tokens, "base_score": sums[1], "score": sums[2]})

    return trimmed_group(run)


def katz(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES, per_bucket: int = ASKED_PER_BUCKET) -> DataFrame:
    """One row per document: doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    Tokens are the words (A-Z in lower case, split at space and 0x09-0x0D), then one end mark.  The model is a Katz backoff over n-grams of up to
    ``order`` words, learnt from the documents that meet ``train`` (a condition on ``doc_id``).  The steps, with tables between them:

    1. Documents form blocks, each with its own dictionary, so that a word or n-gram costs once per block, not once per place.
    2. Blocks ask the word table, which is dealt by word, for ids and counts.
    3. For n = 2 to ``order``: blocks ask the n-gram table, which is dealt by context, for the counts of their n-grams and the sums that
       their contexts' backoff weights are made of.  Hot contexts (over 1/HOT of all training tokens) are dealt by n-gram, so no bucket grows
       with one context's share; the sums of those fewer than HOT contexts of each length are put together by a group-by.
    4. Each block scores its tokens: a seen n-gram has its discounted share, an unseen one its context's weight times what the next
       shorter n-gram gives, recursively; a context that was not learnt hands down all.

    A bucket gets one entry per block and n-gram, however often it stands there.  No table is held in one place: bucket numbers follow the corpus,
    and only count spectra and the sums of hot contexts are collected.

    Words not learnt count as one unknown word.  Null text is the end mark alone.  Without any training text every token is unknown.
    A null id is not trained on and gives a row with a null id.  A repeated row is learnt and scored once per row; very long texts are a
    block of their own; there are no ties to break; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    base = whole_text(docs, id_col, text_col).withColumn("train", F.coalesce(train.cast("int"), F.lit(0)))
    state = scratch.write(base.mapInArrow(_blocks(block_bytes), "block long, words long, tokens long, texts long, data binary"), "blocks")
    n_words, n_tokens, texts = (x or 0 for x in state.agg(F.sum("words"), F.sum("tokens"), F.sum("texts")).first())
    mine = F.pmod(F.xxhash64("block"), F.lit(PARTS))
    states, last = [state.select("block", "data").where(mine == part) for part in range(PARTS)], []
    spectra = [F.sum(F.col("spectrum")[r]) for r in range(K + 1)]

    def asked(name: str, k: int, requests, table) -> DataFrame:
        state = reduce(DataFrame.unionByName, states)
        return scratch.write(state.mapInArrow(_asking(k, requests), ASKED).groupBy("bucket").applyInPandas(table, TABLE), name)

    def in_parts(name: str, run, schema: str) -> list[DataFrame]:
        """What ``run`` makes of each part's blocks and their answers; a part's former table goes as soon as the new one is there."""
        answered, out = answers.where("block is not null").select("block", "bucket", "data"), []
        for part, state in enumerate(states):
            own = state.select("block", F.lit(None).cast("long").alias("bucket"), "data")
            told_to = own.unionByName(answered.where(mine == part))
            out.append(scratch.write(told_to.groupBy("block").applyInPandas(run, schema), f"{name}-{part}"))
            if last:
                scratch.drop(last[part])
        return out

    buckets, tables = 1 + n_words // per_bucket, ["words"]
    answers = asked("words", 1, _word_requests(buckets), _word_table(buckets))
    row = answers.agg(F.sum("tokens"), F.sum("distinct"), *spectra).first()
    model = Model(row[0] or 0, row[1] or 0, texts, [x or 0 for x in row[2:]])
    told = _told_words(buckets)
    buckets = 1 + n_tokens // per_bucket
    for k in range(1, order):
        states = in_parts(f"state-{k}", _state(k, told), "block long, data binary")
        scratch.drop("blocks", *tables)
        last, tables = [f"state-{k}-{part}" for part in range(PARTS)], [f"grams-{k}-{part}" for part in range(k)]
        parts = [asked(name, k, _gram_requests(k, model, buckets, part), _gram_table(k, model)) for part, name in enumerate(tables)]
        answers = reduce(DataFrame.unionByName, parts)
        model.d.append(discounts([x or 0 for x in answers.agg(*spectra).first()]))
        sums = [F.sum(F.col("sums")[i]) for i in range(K + 1)]
        hot = {tuple(r[0]): tuple(r[1:]) for r in answers.where("key is not null").groupBy("key").agg(*sums).collect()}  # fewer than HOT
        told = _told_grams(k, model, buckets, hot)
    scores = in_parts("scores", _scores(order, told, model), SCORES)
    scratch.drop("blocks", *tables)
    return reduce(DataFrame.unionByName, scores)


def op9(docs: DataFrame) -> DataFrame:
    scored = katz(docs, crc_mod("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
