"""Byte-level BPE encoding and decoding with the tiktoken library and a local file of ranks."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, in_chunks, trimmed

PART = 200_000  # characters that the library gets at once, about; a longer stretch without white space is one part
RUN = 20_000  # a run of white space of this many characters is a part of its own (the library's pattern fails beyond a million)
# fixed values: the characters with Unicode's White_Space property, which the pattern's \s means
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_RUNS = re.compile(f"[{WHITE}]{{{RUN},}}")
_CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[{WHITE}])(?=[{WHITE}][^{WHITE}])")


def safe_parts(text: str, part: int = PART) -> Iterator[tuple[str, bool]]:
    """Parts of a text that may be split and merged each on its own, and whether a part is one match of the pattern.

    The pattern takes words, numbers and signs with one leading space at most, and white space otherwise; where something
    follows, a run of white space leaves its last character to a match of its own or to the next word.  So no match crosses
    a change from other characters to white space, nor the place before the last of several white characters that something
    follows, and no match looks further than that: the matches of both sides are the same as in the whole text.
    """
    start = 0
    for run in _RUNS.finditer(text):
        s, e = run.span()
        e -= e < len(text)  # the last white character goes with what follows
        yield from ((p, False) for p in _cuts(text, start, s, part))
        yield text[s:e], True
        start = e
    yield from ((p, False) for p in _cuts(text, start, len(text), part))


def _cuts(text: str, start: int, end: int, part: int) -> Iterator[str]:
    while start < end:
        cut = _CUT.search(text, start + part, end) if end - start > part else None
        stop = cut.start() if cut else end
        yield text[start:stop]
        start = stop


class ByteBpe:
    """Encodes and decodes texts by byte ranks: the ids that the library gives for each match of ``pattern``, without special tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self._library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= min(PART, RUN):
            return self._library.encode_ordinary(text)
        ids: list[int] = []
        for part, whole in safe_parts(text):
            ids += self._library._encode_single_piece(part) if whole else self._library.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes | None:
        """The bytes of the ids, which need not be valid UTF-8; None if any id has no rank."""
        try:
            return self._library.decode_bytes(ids)
        except KeyError:
            return None


@functools.lru_cache(2)
def _codec(ranks: bytes, pattern: str) -> ByteBpe:
    """One per worker and file, whatever the number of its tasks."""
    return ByteBpe(ranks, pattern)


def read_ranks(path: str) -> bytes:
    """The content of a rank file: a line per token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return f.read()


def _ids(lists: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in lists])
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """One row per document: doc_id, ids (array of int); with ``round_trip`` also decoded (the bytes that the ids give back).

    Every match of ``pattern`` is merged on its own; strings of special tokens are ordinary text.  Null and empty text has no ids and
    decodes to no bytes.  Long texts are encoded whole, in parts cut where no match can cross (:func:`safe_parts`); a word of any length
    is one match.  Bytes that are not UTF-8 are read as U+FFFD.  Rows are independent: repeated rows and null ids give a row each, an
    empty table none, and other columns are left out.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # a file of about a megabyte

    def run(batches):
        codec = _codec(*shared.value)
        for batch in batches:
            for b in in_chunks(batch, 1):
                ids = [codec.encode(t.decode("utf-8", "replace")) if t else [] for t in b.column(1).cast("binary").to_pylist()]
                columns = [b.column(0), _ids(ids)]
                if round_trip:
                    columns.append(pa.array(map(codec.decode, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, ids array<int>" + (", decoded binary" if round_trip else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), schema)


def decode(coded: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``coded``: doc_id, decoded (raw bytes).

    A token may end inside a character, so bytes and not text come back; cast them to a string where the ids make up a whole text.
    Null ids decode to null, an empty array to no bytes, an array with a null or with an id that has no rank to null.
    """
    bounded_batches(coded.sparkSession)
    shared = coded.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches):
        codec = _codec(*shared.value)
        for b in batches:
            raw = [None if ids is None or None in ids else codec.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(trimmed(run), "doc_id long, decoded binary")


def op13(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the decoded bytes."""
    import public_tokenizers

    coded = encode(docs, read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, round_trip=True)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
