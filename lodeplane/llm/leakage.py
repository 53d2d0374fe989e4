"""Evaluation passages and questions that leak into training text, with words exchanged here and there.

Both sides become sequences of folded words. Fixed masks (spaced seeds) pick six of nine neighbouring words and ignore
the others; equal hashes of the picked words on both sides are hits, and each hit names a diagonal (a place in the text
against a place in the item). Around the hits the diagonal is compared word by word: a run of at least ``MIN_RUN`` words
with at most one word in ``EXCHANGE`` exchanged is a leak. Either mask alone fits into every window of fifteen words
with any two of them exchanged (tests check all cases), so no such run escapes the hashing.

A word with a hyphen at a line end may go on in the next line, or the hyphen may be its own. Texts with such breaks are
hashed and compared once more as lattices in which every break has both readings, whatever the others have.

The items are the small side. They are broadcast in blocks of at most ``BLOCK_WORDS`` words, so the size of what is sent
is bounded whatever the number of items; each block meets every document whole. The corpus is not shuffled.

Passage and question of an item are one sequence, so that a run may reach from one into the other. A first paragraph that at
least ``SHARED`` items begin with, and that is not all of the text, is an instruction and does not count; passages count however
many items share them. Null and empty
texts on either side give no row; documents delivered twice under one id give their rows once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASKS = ((0, 1, 2, 4, 7, 8), (0, 1, 4, 6, 7, 8))
MIN_RUN = 15
EXCHANGE = 10
SHARED = 3
BLOCK_WORDS = 2_000_000
PIECES = 4  # lines that one word may be spread over

_PARTS = r"\n[ \t\r]*\n"
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|\]\([^()\s]{0,300}\)|<!--|-->")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]{2,8});")
_ESCAPE = re.compile(r"\\[nrt](?![a-z])|\\[nrt](?=[A-Z])|\\(?=[\"'])")
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff]")
_WORDS = re.compile(r"[^\W_]+")
_SOFT = re.compile(r"\xad(?=\s)")
#: From a hyphen at a line end to the next word, over comment and quote marks.
_WRAP = re.compile(r"-(?<=[^\W_]-)(?:[^\w\n\r\v\f\x85\u2028\u2029]|_)*[\n\r\v\f\x85\u2028\u2029](?:\W|_)*(?=[^\W_])")
#: Letters of other scripts that look like Latin ones (fixed values).
_ALIKE = str.maketrans(
    "авекмнорстухіјѕԁԛԝɡһѵıɑ"
    "αβεηικνορτυχϲϳոսօⅼгьп",
    "abekmhopctyxijsdqwghvia" "abenikvoptuxcjnsoLrbn".lower(),
)
_ALIKE_SIGNS = re.compile("[" + "".join(map(chr, _ALIKE)) + "]")
_MARKS = re.compile("[" + "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.combining(c)) + "]+")
_FAR = re.compile("[\U00010000-\U0010ffff]")
_FAR_MARKS = re.compile("[" + "".join(c for c in map(chr, range(0x10000, 0x20000)) if unicodedata.combining(c)) + "]+")  # apart, or the search is slow


def _plain(text: str) -> str:
    """A text without case, markup, hidden characters and look-alikes."""
    if "<" in text or "](" in text:
        text = _TAG.sub(lambda m: "\n" if m.group()[:3].lower() == "<br" else " ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", text)
    if not text.isascii():
        text = _HIDDEN.sub("", _SOFT.sub("-", text))
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        text = (_FAR_MARKS.sub("", text) if _FAR.search(text) else text).casefold()
        return (text.translate(_ALIKE) if _ALIKE_SIGNS.search(text) else text).replace("\u2010", "-")
    return text.lower()


def wrapped_words(text: str | None) -> tuple[list[str], set[int]]:
    """The words of a text, and the indexes of those with a hyphen at a line end."""
    if not text:
        return [], set()
    text = _plain(text)
    wraps = {m.start() for m in _WRAP.finditer(text)}
    if not wraps:
        return _WORDS.findall(text), set()
    found = list(_WORDS.finditer(text))
    return [m.group() for m in found], {i for i, m in enumerate(found) if m.end() in wraps}


def words_of(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, layout, markup, hidden characters and look-alikes."""
    return wrapped_words(text)[0]


def joined_words(text: str | None) -> list[str]:
    """The same with all words rejoined whose hyphen stands at a line end."""
    words, wraps = wrapped_words(text)
    out: list[str] = []
    for i, w in enumerate(words):
        if i - 1 in wraps:
            out[-1] += w
        else:
            out.append(w)
    return out


class Items:
    """Seed table and word sequences of one block of items."""

    def __init__(self, sequences: list[tuple[int, list[str]]]):
        self.vocab: dict[str, int] = {}
        for _, ws in sequences:
            for w in ws:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        self.item = np.array([i for i, _ in sequences], np.int64)
        coded = [np.array([self.vocab[w] for w in ws], np.int64) for _, ws in sequences]
        self.start = np.cumsum([0] + [len(c) for c in coded])
        self.codes = np.concatenate([np.zeros(0, np.int64), *coded])
        self.owner = np.repeat(np.arange(len(coded)), [len(c) for c in coded])
        self.seeds, self.at = [], []
        for k, mask in enumerate(MASKS):
            n = len(self.codes) - mask[-1]
            at = np.arange(max(n, 0))
            at = at[self.owner[at] == self.owner[at + mask[-1]]] if len(at) else at
            h = seed_hashes(self.codes, at, mask)
            order = np.argsort(h, kind="stable")
            self.seeds.append(h[order])
            self.at.append(at[order])


_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def seed_hashes(codes: np.ndarray, at: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for m, k in zip(mask, _MULT):
        h ^= (codes[at + m].astype(np.uint64) + np.uint64(1)) * k
        h = (h << np.uint64(23)) | (h >> np.uint64(41))
    return h


def tolerant_run(same: np.ndarray) -> bool:
    """Whether some stretch of at least MIN_RUN words has at most one in EXCHANGE exchanged (rounded, two of the shortest)."""
    n = len(same)
    if n < MIN_RUN:
        return False
    wrong = np.concatenate([[0], np.cumsum(~same)])
    for length in range(MIN_RUN, min(n, 2 * MIN_RUN) + 1):  # a longer good stretch holds a good one of these lengths
        allowed = int(length / EXCHANGE + 0.5)
        if (wrong[length:] - wrong[:-length] <= allowed).any():
            return True
    return False


def wrapped_hits(items: Items, words: list[str], wraps: set[int]) -> set[int]:
    """Sequences that leaked into a text with words on two lines, at any choice between the readings of each."""
    get, n = items.vocab.get, len(words)
    edges: list[list[tuple[int, int]]] = []  # of each word, the words that may begin there: (index after it, code)
    for i, w in enumerate(words):
        ends = [(i + 1, get(w, 0))]
        for j in range(i, min(i + PIECES - 1, n - 1)):
            if j not in wraps:
                break
            w += words[j + 1]
            ends.append((j + 2, get(w, 0)))
        edges.append(ends)
    starts = sorted({i for b in wraps for i in range(max(0, b - 2 * MIN_RUN), min(n, b + 2 * MIN_RUN + 1))})
    codes = np.array([e[0][1] for e in edges], np.int64)
    longer = [(i, j, c) for i, e in enumerate(edges) for j, c in e[1:]]
    found: set[int] = set()
    for mask, seeds, where in zip(MASKS, items.seeds, items.at):
        at, picked = [], []
        for i in starts:
            paths: set[tuple[int, tuple[int, ...]]] = {(i, ())}
            for o in range(mask[-1] + 1):
                pick = o in mask
                paths = {(j, (*seen, c) if pick else seen) for k, seen in paths if k < n for j, c in edges[k] if c or not pick}
                if not paths:
                    break
            for seen in {seen for _, seen in paths}:
                at.append(i)
                picked.extend(seen)
        if not at or not len(seeds):
            continue
        h = seed_hashes(np.array(picked, np.int64), np.arange(len(at)) * len(mask), tuple(range(len(mask))))
        lo, hi = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
        for i, a, b in zip(at, lo.tolist(), hi.tolist()):
            for place in where[a:b].tolist():
                s = int(items.owner[place])
                if s not in found and wrapped_run(items, s, place, codes, longer, i):
                    found.add(s)
    return found


def wrapped_run(items: Items, s: int, place: int, codes: np.ndarray, longer: list[tuple[int, int, int]], at: int) -> bool:
    """``tolerant_run`` of some stretch around a hit over the lattice of the text. Each step lengthens all paths by a word."""
    reach = 2 * MIN_RUN
    own = items.codes[max(int(items.start[s]), place - reach) : min(int(items.start[s + 1]), place + reach)]
    first, last = max(0, at - PIECES * reach), min(len(codes), at + PIECES * reach)
    wrong = codes[first:last, None] != own[None, :]
    jumps = [(i - first, j - first, own != c) for i, j, c in longer if first <= i and j <= last]
    least = np.zeros((last - first + 1, len(own) + 1), np.int16)
    for length in range(1, reach + 1):
        new = np.full_like(least, reach)
        new[1:, 1:] = least[:-1, :-1] + wrong
        for i, j, differ in jumps:
            new[j, 1:] = np.minimum(new[j, 1:], least[i, :-1] + differ)
        least = new
        if length >= MIN_RUN and (least <= int(length / EXCHANGE + 0.5)).any():
            return True
    return False


def hits(items: Items, texts: list[str | None]) -> list[tuple[int, int]]:
    """(index of the text, item id) of the leaks in a batch of texts."""
    get, codes, lens, broken = items.vocab.get, [], [], []
    for t in texts:
        ws, wraps = wrapped_words(t)
        if wraps:
            broken.append((len(lens), ws, wraps))
        lens.append(len(ws))
        codes.extend(map(get, ws))
    doc = np.array([c or 0 for c in codes], np.int64)
    if not len(doc) or not len(items.codes):
        return []
    owner = np.repeat(np.arange(len(lens)), lens)
    first = np.cumsum([0] + lens)
    diagonals: set[tuple[int, int, int]] = set()
    for mask, seeds, where in zip(MASKS, items.seeds, items.at):
        n = len(doc) - mask[-1]
        if n <= 0 or not len(seeds):
            continue
        at = np.arange(n)
        ok = owner[at] == owner[at + mask[-1]]
        for m in mask:
            ok &= doc[at + m] > 0
        at = at[ok]
        h = seed_hashes(doc, at, mask)
        lo, hi = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
        hit = hi > lo
        at, lo, hi = at[hit], lo[hit], hi[hit]
        many = hi - lo
        if not len(at):
            continue
        places = where[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        at = np.repeat(at, many)
        diagonals.update(zip(owner[at].tolist(), items.owner[places].tolist(), (at - places).tolist()))
    found = set()
    for d, s, shift in diagonals:
        if (d, int(items.item[s])) in found:
            continue
        lo = max(int(items.start[s]), int(first[d]) - shift)
        hi = min(int(items.start[s + 1]), int(first[d + 1]) - shift)
        if hi - lo >= MIN_RUN and tolerant_run(items.codes[lo:hi] == doc[lo + shift : hi + shift]):
            found.add((d, int(items.item[s])))
    for d, ws, wraps in broken:
        found.update((d, int(items.item[s])) for s in wrapped_hits(items, ws, wraps))
    return sorted(found)


def _blocks(rows: Iterator, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for item, ws in rows:
        if size + len(ws) > block_words and block:
            yield block
            block, size = [], 0
        block.append((item, ws))
        size += len(ws)
    if block:
        yield block


def leaked_items(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``key`` and ``item_key`` of every document and item that leaked into it."""
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null and text <> ''")
    kind = slim.schema["key"].dataType.simpleString()
    # Held-out items are written by hand; they stream through the driver block by block and are never held together.
    rows = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    rows = rows.dropDuplicates(["item", "text"])
    parts = rows.select("item", "text", F.split("text", _PARTS).alias("parts"))
    heads = parts.where("size(parts) > 1").groupBy(F.col("parts")[0].alias("head")).agg(F.countDistinct("item").alias("n")).where(F.col("n") >= SHARED).select("head")
    rows = parts.join(heads, (F.col("parts")[0] == F.col("head")) & (F.size("parts") > 1), "left").select("item", "text", F.when(F.col("head").isNull(), F.col("parts")).otherwise(F.slice("parts", F.lit(2), F.size("parts"))).alias("parts"))
    readings = lambda ps: [s for k, s in enumerate([w for p in ps for w in f(p)] for f in (words_of, joined_words)) if not k or any(wrapped_words(p)[1] for p in ps)]
    sequences = ((r.item, ws) for r in rows.orderBy("item", "text").toLocalIterator() for ws in readings(r.parts))
    found = None
    for block in _blocks(((i, ws) for i, ws in sequences if len(ws) >= MIN_RUN), block_words):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            table = Items(sent.value)
            for batch in batches:
                keys, texts = batch.column("key"), batch.column("text").to_pylist()
                pairs = [p for i in range(0, len(texts), 500) for p in ((d + i, item) for d, item in hits(table, texts[i : i + 500]))]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([d for d, _ in pairs], pa.int64())), pa.array([i for _, i in pairs], pa.int64())], names=["key", "item"])

        part = slim.mapInArrow(run, f"key {kind}, item bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = slim.select("key", F.lit(None).cast("bigint").alias("item")).where(F.lit(False))
    return found.distinct().select(F.col("key").alias(key), F.col("item").alias(item_key))


def leak_report(leaks: DataFrame, item_key: str = "item_id", key: str = "doc_id") -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    return leaks.groupBy(item_key).agg(F.countDistinct(key).alias("documents"))


