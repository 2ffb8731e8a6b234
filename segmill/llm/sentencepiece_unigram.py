"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, trimmed

MARK = "▁"  # stands for a space
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
UNKNOWN_PENALTY = 10.0  # an uncovered character scores this much below the lowest piece
LONG_WORD = 48  # bytes; longer words take the scalar path, so that a batch stays dense
CACHE = 300_000  # words whose ids a worker remembers


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: texts, log scores and types by id; whether a marker is put before the text."""

    texts: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[int, ...]
    dummy_prefix: bool = True
    kind: str = "unigram"


def _fields(data: bytes):
    """Number, wire type and value of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, data[at : at + n]
        at += n


def read_model(path: str) -> Pieces:
    """The pieces of a SentencePiece model file.  Its texts must not be normalised beyond spaces (identity rule, spaces kept).

    Scores are taken as they stand.  In a file of kind ``bpe`` they are negated merge ranks, not log probabilities: the segmentation of the greatest
    sum of such scores is well defined, but is not what the library gives for that file, which merges pairs instead.
    """
    texts, scores, types, dummy, kind = [], [], [], True, "unigram"
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            texts.append(piece[1].decode())
            scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
            types.append(piece.get(3, NORMAL))
        elif number == 2:
            kind = {1: "unigram", 2: "bpe", 3: "word", 4: "char"}[dict(_fields(value)).get(3, 1)]
        elif number == 3:
            spec = dict(_fields(value))
            dummy = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1):
                raise ValueError("only models that keep the text as it is are supported")
    return Pieces(tuple(texts), tuple(scores), tuple(types), dummy, kind)


class DoubleArray:
    """A double-array trie over byte strings: child ``c`` of node ``n`` is ``base[n] + c + 1`` if its check is ``n``."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        low, hint = 258, [0] * 9  # the first free place that any child can take; by number of children, where the last search ended
        todo = [(tree, 0)]
        while todo:
            node, at = todo.pop()
            value[at] = node.get(-1, -1)
            kids = sorted(c for c in node if c >= 0)
            if not kids:
                continue
            while check[low] >= 0:
                low += 1
                if low + 600 > len(check):
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
            many = min(len(kids), 8)
            b = max(hint[many], low - kids[0] - 1)
            while True:
                if b + 600 > len(check):
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                if all(check[b + c + 1] < 0 for c in kids):
                    break
                b += 1
            base[at] = b
            if many > 1:
                hint[many] = b
            for c in kids:
                check[b + c + 1] = at
            todo.extend((node[c], b + c + 1) for c in kids)
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base, check, value))


class Unigram:
    """Segments texts into the pieces of the highest total score.

    Scores are added as 64-bit floats from the left.  Of several best paths to a place, the one whose last piece starts
    first is taken.  No piece holds a marker after another character, and no piece holds any character that the vocabulary
    has alone at most; a text is therefore cut before each marker and at line ends, and each part is segmented once.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        keys, lowest = {}, 0.0
        self.unknown = next((i for i, t in enumerate(pieces.types) if t == UNKNOWN), 0)
        self.bytes = np.full(256, self.unknown, np.uint32)
        for i, (text, score, kind) in enumerate(zip(pieces.texts, pieces.scores, pieces.types, strict=True)):
            if kind in (NORMAL, USER):
                keys[text.encode()] = i
            if kind == NORMAL:
                lowest = min(lowest, score)
            if kind == BYTE:
                self.bytes[int(text[3:5], 16)] = i
        self.fallback = BYTE in pieces.types
        self.trie = DoubleArray(keys)
        self.scores = np.array(pieces.scores, np.float64)
        top = max((s for s, k in zip(pieces.scores, pieces.types, strict=True) if k == NORMAL), default=0.0)
        for i, (text, kind) in enumerate(zip(pieces.texts, pieces.types, strict=True)):
            if kind == USER:  # pieces set by hand win over any others: each byte scores as the best piece does
                self.scores[i] = len(text.encode()) * top - 0.1
        self.uncovered = lowest - UNKNOWN_PENALTY
        inner = "".join(t[1:] for t, k in zip(pieces.texts, pieces.types, strict=True) if k in (NORMAL, USER) and len(t.strip(MARK)))
        self.split_spaces = MARK not in inner
        self.split_lines = "\n" not in inner and not any(t.startswith("\n") and len(t) > 1 for t in pieces.texts)
        plain = [b"" if k in (CONTROL, UNUSED) else bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(MARK, " ").encode() for t, k in zip(pieces.texts, pieces.types, strict=True)]
        plain[self.unknown] = " ⁇ ".encode()
        self._plain = plain
        self._lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()
        self._seen: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    # -- segmentation

    def _ids_of_path(self, word: bytes, cuts: list[tuple[int, int]]) -> bytes:
        """Ids of a path given as (start, id) from the left, uncovered characters as bytes."""
        out, stop = [], [s for s, _ in cuts[1:]] + [len(word)]
        for (start, piece), end in zip(cuts, stop, strict=True):
            if piece >= 0:
                out.append(piece)
            elif self.fallback:
                out.extend(self.bytes[c] for c in word[start:end])
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def _scalar(self, word: bytes) -> bytes:
        base, check, value, scores = self._lists
        n, low = len(word), float("-inf")
        best, start, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = word[at]
            width = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, node, single = best[at], 0, False
            for end in range(at, n):
                nxt = base[node] + word[end] + 1
                if check[nxt] != node:
                    break
                node = nxt
                v = value[node]
                if v >= 0:
                    single = single or end + 1 - at == width
                    if here + scores[v] > best[end + 1]:
                        best[end + 1], start[end + 1], piece[end + 1] = here + scores[v], at, v
            if not single and here + self.uncovered > best[at + width]:
                best[at + width], start[at + width], piece[at + width] = here + self.uncovered, at, -1
            at += width
        cuts, at = [], n
        while at > 0:
            cuts.append((start[at], piece[at]))
            at = start[at]
        return self._ids_of_path(word, cuts[::-1])

    def _batch(self, words: list[bytes]) -> list[bytes]:
        """Viterbi over many short words at once: all words take one start position, then one trie step, at a time."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        lens = np.array([len(w) for w in words])
        order = np.argsort(-lens, kind="stable")
        lens = lens[order]
        width = int(lens[0])
        text = np.zeros((len(words), width + 5), np.int32)
        flat = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        inside = np.arange(width + 5) < lens[:, None]
        text[inside] = flat
        best = np.full((len(words), width + 5), -np.inf)
        start = np.zeros(best.shape, np.int16)
        piece = np.full(best.shape, -1, np.int32)
        best[:, 0] = 0
        for s in range(width):
            live = np.flatnonzero((lens[: np.searchsorted(-lens, -s, "left")] > s) & ((text[: np.searchsorted(-lens, -s, "left"), s] & 0xC0) != 0x80))
            if not len(live):
                continue
            lead = text[live, s]
            size = np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            here = best[live, s]
            single = np.zeros(len(live), bool)
            node, rows, k = np.zeros(len(live), np.int32), np.arange(len(live)), s
            while len(rows):
                nxt = base[node] + text[live[rows], k] + 1
                ok = (check[nxt] == node) & (k < lens[live[rows]])
                rows, node = rows[ok], nxt[ok]
                k += 1
                v = value[node]
                hit = np.flatnonzero(v >= 0)
                if len(hit):
                    r, v = rows[hit], v[hit]
                    single[r] |= k - s == size[r]
                    cand = here[r] + self.scores[v]
                    better = cand > best[live[r], k]
                    r, v, cand = live[r[better]], v[better], cand[better]
                    best[r, k], start[r, k], piece[r, k] = cand, s, v
                if k >= width:
                    break
            r = np.flatnonzero(~single)
            end = s + size[r]
            cand = here[r] + self.uncovered
            better = cand > best[live[r], end]
            r, end, cand = live[r[better]], end[better], cand[better]
            best[r, end], start[r, end], piece[r, end] = cand, s, -1
        out: list[bytes] = [b""] * len(words)
        starts, ids = start.tolist(), piece.tolist()
        for row, i in enumerate(order.tolist()):
            cuts, at, srow, prow = [], int(lens[row]), starts[row], ids[row]
            plain = True
            while at > 0:
                cuts.append((srow[at], prow[at]))
                plain &= prow[at] >= 0
                at = srow[at]
            cuts.reverse()
            out[i] = np.array([p for _, p in cuts], "<u4").tobytes() if plain else self._ids_of_path(words[i], cuts)
        return out

    def _parts(self, text: str):
        """Cuts a text into (marked, rest) parts: marked ones begin with a marker that ``rest`` leaves out."""
        if not self.split_spaces or "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
            text = (MARK if self.pieces.dummy_prefix else "") + text.replace(" ", MARK)
            if not self.split_spaces:
                return [(False, text)]
            return [(False, w) for w in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text)]
        out = []
        for i, line in enumerate(text.split("\n")) if self.split_lines else [(0, text)]:
            head, *rest = line.split(" ")
            if i:
                out.append((False, "\n"))
            if i == 0 and self.pieces.dummy_prefix:
                out.append((True, head))
            elif head:
                out.append((False, head))
            out.extend([(True, w) for w in rest])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if sum(map(len, self._seen)) > CACHE:
            for c in self._seen:
                c.clear()
        parts = [self._parts(t) if t else [] for t in texts]
        new = [{w for p in parts for m, w in p if m == marked and w not in self._seen[marked]} for marked in (False, True)]
        for marked in (False, True):
            words = list(new[marked])
            data = [((MARK + w) if marked else w).encode() for w in words]
            short = [i for i, d in enumerate(data) if len(d) <= LONG_WORD]
            seen = self._seen[marked]
            if short:
                for i, ids in zip(short, self._batch([data[i] for i in short]), strict=True):
                    seen[words[i]] = ids
            for w, d in zip(words, data, strict=True):
                if len(d) > LONG_WORD:
                    seen[w] = self._scalar(d)
        out = [b"".join([self._seen[m][w] for m, w in p]) for p in parts]
        for marked in (False, True):  # long words are not kept
            for w in new[marked]:
                if len(w) > LONG_WORD:
                    del self._seen[marked][w]
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids: markers become spaces, byte pieces join to UTF-8 (invalid bytes to U+FFFD), the leading space goes."""
        data = b"".join(map(self._plain.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.pieces.dummy_prefix and text[:1] == " " else text


def _run(shared):
    def run(batches):
        model = Unigram(shared.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i in range(0, len(texts), 256):
                part = [t or "" for t in texts[i : i + 256]]
                ids = model.encode(part)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 256), pa.array(ids, pa.binary()), pa.array(map(model.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return trimmed(run)


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (packed little-endian unsigned 32-bit integers), decoded (the text those ids give back).

    Spaces become markers, one more is put before the text if the vocabulary says so, and nothing else is changed.
    Characters that no piece covers become their UTF-8 bytes' pieces.  Null and empty text has no ids and decodes to the
    empty text; very long texts and words are segmented whole; of equal sums the path whose last piece starts first is taken.  A text that itself holds the marker decodes with a space in its place.  Rows are independent of each other.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # one vocabulary, some MB
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run(shared), "doc_id long, ids binary, decoded string")


def op1(docs: DataFrame) -> DataFrame:
    """Digest of the ids and of the round trip.

    The one public file of pieces is of kind ``bpe``, and tokenizers are not to be trained: its merge ranks serve as the scores, so the ids
    differ from those that the library gives for the file (:func:`read_model`); decoding gives the text back all the same.
    """
    import public_tokenizers

    coded = encode(docs, read_model(public_tokenizers.path("piece_bpe_32k.model")))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


