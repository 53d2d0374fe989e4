"""Encoding of whole texts with a byte-level BPE vocabulary by a monoid tree reduction.

A text is halved until the pieces are short, the pieces are encoded alone, and neighbours are joined. An element of the
monoid is the encoding of a stretch of the text *as if it stood alone*, with the ends of its pre-token pieces. Joining
re-encodes a window around the seam and grows it until both sides provably stabilise:

* left: the pattern looks at most two characters past the end of a piece, so every piece that ends three characters
  before the seam is the same whatever follows;
* right: the pattern never looks back, so from the first position where a piece of the window ends at a piece end of
  the right element (and three characters before the window's own end) all later pieces are those already known.

The merges of the vocabulary stay within pieces, hence equal pieces give equal ids. Decoding is the homomorphism back:
the bytes of the halves are concatenated up the same tree.

Defined results: a null and an empty text give an empty list; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published split pattern of the byte-level vocabularies (fixed value); white space by its Unicode property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
TOKENIZERS = os.environ.get("LODEPLANE_TOKENIZERS", "/opt/tokenizers")
LEAF_CHARS = 512
_AHEAD = 3  # a piece is settled by the two characters after it
_CACHE = 200_000


class Encoder:
    """Pieces and merges of one rank file."""

    def __init__(self, ranks: bytes, leaf_chars: int = LEAF_CHARS):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self._find = regex.compile(PATTERN).finditer
        self._one = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})._encode_single_piece
        self._bytes = {v: k for k, v in table.items()}
        self._known: dict[str, list[int]] = {}
        self.leaf_chars = leaf_chars

    def _ids(self, piece: str) -> list[int]:
        ids = self._known.get(piece)
        if ids is None:
            if len(self._known) >= _CACHE:
                self._known.clear()
            ids = self._one(piece)
            if len(piece) < 64:
                self._known[piece] = ids
        return ids

    def _alone(self, text: str, start: int, end: int) -> tuple[list[int], list[int], list[int]]:
        """The element of ``text[start:end]``: ids, ends of the pieces in the text, number of ids up to each end."""
        ids: list[int] = []
        ends: list[int] = []
        upto: list[int] = []
        for m in self._find(text, start, end):
            ids += self._ids(m.group())
            ends.append(m.end())
            upto.append(len(ids))
        return ids, ends, upto

    def _join(self, text: str, start: int, seam: int, end: int, a, b):
        ia, ea, ua = a
        ib, eb, ub = b
        k = bisect_left(ea, seam - _AHEAD + 1)  # pieces of the left element that are settled
        from_, kept = (ea[k - 1], ua[k - 1]) if k else (start, 0)
        reach = 32
        while True:
            stop = min(end, seam + reach)
            iw, ew, uw = self._alone(text, from_, stop)
            for j, e in enumerate(ew):
                if e <= seam or (e > stop - _AHEAD and stop < end):
                    continue
                i = bisect_left(eb, e)
                if i < len(eb) and eb[i] == e:
                    off = kept + uw[j] - ub[i]
                    return ia[:kept] + iw[: uw[j]] + ib[ub[i] :], ea[:k] + ew[: j + 1] + eb[i + 1 :], ua[:k] + [kept + u for u in uw[: j + 1]] + [off + u for u in ub[i + 1 :]]
            reach *= 2

    def _tree(self, text: str, start: int, end: int):
        if end - start <= self.leaf_chars:
            return self._alone(text, start, end)
        mid = (start + end) // 2
        return self._join(text, start, mid, end, self._tree(text, start, mid), self._tree(text, mid, end))

    def encode(self, text: str | None) -> list[int]:
        return self._tree(text, 0, len(text))[0] if text else []

    def decode(self, ids: list[int]) -> str:
        return self._down(ids, 0, len(ids)).decode("utf-8", "replace")

    def _down(self, ids: list[int], lo: int, hi: int) -> bytes:
        if hi - lo <= 4096:
            return b"".join(self._bytes[i] for i in ids[lo:hi])
        mid = (lo + hi) // 2
        return self._down(ids, lo, mid) + self._down(ids, mid, hi)


def rank_file(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``key`` and ``ids`` of every row; other columns are ignored. One narrow pass in Arrow batches.

    The rank file (under 1 MB, the size of a vocabulary and not of the data) is read once on the driver and broadcast.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ranks = docs.sparkSession.sparkContext.broadcast(rank_file(name, folder))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, leaf_chars)
        for batch in batches:
            ids = pa.array([encoder.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids], names=["key", "ids"])

    return slim.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def decode_ids(encoded: DataFrame, *, key: str = "doc_id", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``text`` of rows of ``encode_texts``; an empty or null list gives an empty text."""
    slim = encoded.select(F.col(key).alias("key"), "ids")
    ranks = encoded.sparkSession.sparkContext.broadcast(rank_file(name, folder))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            texts = pa.array([encoder.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), texts], names=["key", "text"])

    return slim.mapInArrow(run, f"key {kind}, text string").select(F.col("key").alias(key), "text")
