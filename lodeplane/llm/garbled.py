"""Text decoded with the wrong character encoding: find it and give the original back where that is possible.

A swap of code pages is a substitution cipher: bytes written in one page were read in another, so every character seen
stands for a byte, and the bytes for letters. Which cipher was used is unknown and may differ per source. The operator
runs expectation-maximisation over three kinds of hidden things:

* the language: counts of character bigrams over the words of *all* documents, hashed into a table of fixed size,
  re-estimated without the words of the documents that the last round found garbled (M-step), until a round finds the
  same documents as the one before;
* the cipher of each suspicious text: pairs of known code pages start as tables of bytes to letters; their likelihood is
  that of the restored words under the bigrams (E-step), their prior the share the pair has among the garbled texts of
  the same source (M-step of the same rounds);
* the mapping of bytes to letters of each source: expected counts of what each character seen stands for. Words that no
  known page explains get a free start: their bigram counts per source are a substitution cipher solved against the
  bigrams of each script, which needs no page to be known.

``translate`` applies the mappings to the words of a text. All evidence is weighed once per distinct word of the corpus, however often
it occurs. A text is garbled if its best cipher explains the suspicious words better than leaving them as they are, by a
margin in nats. Bytes that are lost (U+FFFD within words) are a cipher of their own: one symbol for many letters.

Defined results: null, empty and pure ASCII texts are never found. Rows with equal ids are judged each by its own text; equal rows
give one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeplane.session import materialise

BITS = 20
MARGIN = 11.0  # nats by which the best cipher must beat the text as it is
SENT_BYTES = 32 << 20  # size of the suspicious words up to which they are sent to the texts; beyond it both sides are shuffled
PRIOR = 20.0  # texts of a source that the shares over all sources count for
COST = 6.0  # nats that each letter of a mapping learned from a free start must earn over the whole source
LEAST_SYMBOLS = 300  # characters that no page explains from which a source gets a free start
_LOST = "�"
_LOST_IN_WORD = re.compile(r"��|\w�|�\w")

#: Pages in which bytes may have been read, and in which they may have been written (names of Python codecs).
READ_SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-9", "iso8859-15", "koi8-r", "koi8-u", "cp437", "cp737", "cp850", "cp852", "cp866", "mac-roman", "mac-cyrillic", "mac-latin2", "mac-greek", "mac-turkish", "cp1255", "cp1256", "cp1258", "cp874", "cp857", "cp775")
READ_MULTI = ("gb18030", "gbk", "big5", "cp932", "cp949", "euc_jp")
WRITTEN = ("utf-8", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-9", "koi8-r", "koi8-u", "cp437", "cp737", "cp850", "cp852", "cp866", "mac-roman", "mac-cyrillic", "mac-latin2", "gb18030", "big5", "cp932", "cp949", "euc_jp")


@lru_cache(None)
def _bytes_of(page: str) -> dict[int, int]:
    """Character -> byte as code point, for ``translate``; bytes that the page leaves undefined stand for themselves."""
    table = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            c = chr(b)
        if len(c) == 1:
            table[ord(c)] = b
    for b in range(128, 160):  # control characters that a lenient decoder passes through
        table.setdefault(b, b)
    for c in range(128, 256):
        if c not in table:
            table[c] = 0x2603 + c  # not of this page; makes the encoding fail
    return table


_SIGNS = r"\x00-\x7f\u00a0-\u00bf\u2010-\u203a\u20a0-\u20bf\u2116\u2122\u2190-\u21ff\u2713-\u2718"
#: One script and signs: what a word looks like once it is read right. Anything else is not worth weighing.
_ONE_SCRIPT = re.compile("|".join(rf"[{_SIGNS}{block}]+\Z" for block in (
    r"\u00c0-\u024f\u0300-\u036f\u1e00-\u1eff\ufb00-\ufb06", r"\u0370-\u03ff\u1f00-\u1fff\u00b5", r"\u0400-\u052f", r"\u1100-\u11ff\u3130-\u318f\uac00-\ud7af\u3000-\u303f\uff00-\uff65",
    r"\u3000-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0002ffff", r"\u2500-\u25ff", r"\u0590-\u05ff", r"\u0600-\u06ff\u0750-\u077f", r"\u0e00-\u0e7f", r"\u0900-\u0d7f", r"\u0530-\u058f", r"\u10a0-\u10ff", r"\u2000-\u2bff\ufe0f\U0001f000-\U0001faff",
))).match


def _to_bytes(word: str, page: str) -> bytes | None:
    try:
        if page in READ_MULTI:
            return word.replace(_LOST, "").encode(page)
        return word.translate(_bytes_of(page)).encode("latin-1")
    except UnicodeEncodeError:
        return None


@lru_cache(20_000)
def _readings(word: str) -> list[tuple[str, str, str]]:
    """(page read, page written, word restored) of every pair of pages that the word allows; later rounds ask again."""
    out = []
    seen: dict[tuple[bytes, str], str | None] = {}
    for page in READ_SINGLE + READ_MULTI:
        raw = _to_bytes(word, page)
        if raw is None or raw.isascii():
            continue
        for true in WRITTEN if _may_swap(word) else WRITTEN[:1]:
            if true == page or (page in READ_MULTI and true in READ_SINGLE):
                continue
            k = (raw, true)
            if k not in seen:
                try:
                    seen[k] = raw.decode(true)
                except UnicodeDecodeError:
                    fixed = raw.decode(true, "ignore") if true == "utf-8" or page in READ_MULTI else None
                    odd = sum(b > 127 for b in raw)
                    kept = len(fixed.encode(true, "ignore")) if fixed else 0
                    seen[k] = fixed if fixed and len(raw) - kept <= 0.34 * odd and not fixed.isascii() else None
            fixed = seen[k]
            if fixed and true == "utf-8" and page in ("cp1252", "cp1250", "latin-1") and (twice := _to_bytes(fixed, page)) and not twice.isascii():
                inner = twice.decode("utf-8", "ignore")
                if not inner.isascii() and len(twice) - len(inner.encode()) <= 0.34 * sum(b > 127 for b in twice):
                    out.append((page, "utf-8 twice", inner))
            if fixed and fixed != word and _ONE_SCRIPT(fixed):
                out.append((page, true, fixed))
    return out


#: Blocks whose characters make a word that is UTF-8 once more hard evidence: scripts and signs that common texts use.
_COMMON = re.compile(r"^[\x00-\x7f\u00a0-\u017f\u0370-\u0481\u1e00-\u1eff\u2010-\u2027\u2030-\u203a\u20ac\u2122\u2190-\u21ff\u2500-\u257f\u2705-\u2718\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff01-\uff5e]+$")
_BLANK = re.compile(r"[\u00a0\u00ad\u200b-\u200f\u2060\ufeff]")


#: C1 controls, long runs of the upper half of Latin-1, and capitals within Cyrillic words that begin small.
_UNLIKELY = re.compile(r"[\u0080-\u009f]|[\u00a0-\u00ff]{4}|[\u0430-\u044f][\u0410-\u042f]{2}")


_PROBES = ("cp1252", "cp1250", "cp1251", "cp1253", "cp437", "cp850", "cp852", "cp866", "mac-roman", "gb18030", "cp932")


def hard_evidence(word: str) -> bool:
    """Whether the first round must keep a word out of the language: it is valid UTF-8 once more, or holds lost bytes."""
    if _LOST_IN_WORD.search(word) or _UNLIKELY.search(word):
        return True
    for page in _PROBES:
        raw = _to_bytes(word, page)
        if raw and not raw.isascii():
            try:
                fixed = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if not fixed.isascii() and _COMMON.match(fixed):
                return True
    return False


_ALIKE = frozenset("авекмнорстухіјѕԁԛԝɡһѵАВЕКМНОРСТУХІЈЅαεικνορτυχΑΒΕΗΙΚΜΝΟΡΤΥΧΖ")


def _may_swap(word: str) -> bool:
    """Whether one letter for another can be told at all in the word: it needs visible odd letters beside other letters."""
    bare = _BLANK.sub("", word)
    odd = [c for c in bare if c > "\x7f"]
    if not odd or sum(c.isalpha() for c in bare) < 3:
        return False
    # letters of another script that look like Latin ones, within Latin words, are a disguise and no wrong page
    return not (all(c in _ALIKE for c in odd) and any("a" <= c <= "z" for c in bare.lower()))


_DIGITS = {ord(c): "0" for c in "123456789"} | {ord(c): " " for c in "\t\r\n"}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer((" " + text.translate(_DIGITS) + " ").encode("utf-32-le"), np.uint32)


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint32(0x9E3779B1) ^ (b * np.uint32(0x85EBCA6B) + np.uint32(0x165667B1))
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


class Bigrams:
    """Log-likelihoods from hashed counts; unigram counts sit in the slot of the pair (character, 0)."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray):
        table = np.zeros(1 << BITS)
        table[slots] = counts
        self.table, total = table, max(1.0, counts.sum() / 2)
        self.floor = 5e-9 * total  # the count of a pair that was never seen
        self.rare = 2e-5 * total + 1  # a context this rare predicts nothing
        self.cache: dict[str, float] = {}

    def loglik(self, word: str) -> float:
        """Of the word between blanks, over the bigrams with a character beyond ASCII."""
        v = self.cache.get(word)
        if v is None:
            c = _codes(word)
            a, b = c[:-1], c[1:]
            odd = (a > 127) | (b > 127)
            a, b = a[odd], b[odd]
            p = (self.table[_slots(a, b)] + self.floor) / (self.table[_slots(a, np.zeros_like(a))] + self.rare)
            v = float(np.log(np.minimum(p, 1.0)).sum()) if len(a) else 0.0
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[word] = v
        return v


def _odd_pairs(word: str) -> int:
    prev, n = False, 0
    for ch in word + " ":
        odd = ch > "\x7f"
        n += odd or prev
        prev = odd
    return n


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: the words between blanks of all texts, combined on the map side."""
    words = docs.select(F.explode(F.split(F.col(text), r"[ \t\r\n]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def bigram_counts(words: DataFrame, first: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigram counts over ``word, n``: at most 2**BITS slots, whatever the size of the corpus. The first round leaves
    out the words with hard evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.float64)
        for batch in batches:
            rows = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if n > 0 and (not first or w.isascii() or not hard_evidence(w))]
            if rows:
                c = _codes(" ".join(w for w, _ in rows))
                n = np.repeat([float(n) for _, n in rows], [len(w) + 1 for w, _ in rows])  # the blank before each word is its own
                total += np.bincount(_slots(c[:-1], c[1:]), weights=n, minlength=1 << BITS)
                total += np.bincount(_slots(c[:-1], np.zeros_like(c[:-1])), weights=n, minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["slot", "n"])

    rows = words.select("word", "n").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    return rows.column("slot").to_numpy().astype(np.int64), rows.column("n").to_numpy().astype(np.float64)


def _lost_gain(model: Bigrams, word: str) -> float:
    """Gain of reading lost bytes as unknown letters: a letter after a letter costs what it costs on the whole."""
    gain, padded = 0.0, f" {word} "
    for m in re.finditer(r"�+", padded):
        before, after = padded[m.start() - 1], padded[m.end()]
        if len(m.group()) == 1 and not (before.isalnum() or after.isalnum()):
            continue
        seen = model.loglik(padded[m.start() - 1 : m.end() + 1]) if before.strip() else model.loglik(padded[m.start() : m.end() + 1])
        n = len(m.group()) + 1
        gain += max(0.0, -seen - 4.0 * n)
    return gain


_MULTI_BYTE = frozenset(("utf-8", "utf-8 twice", *READ_MULTI))
_READING = "word string, fixed string, gain double, pages array<struct<page:string,true:string>>, open boolean"


def word_readings(lm: Bigrams, word: str) -> list[tuple[str, float, list[tuple[str, str]]]] | None:
    """Readings of one word that beat it as it stands: restored word, gain, and the pairs of pages that give it; None for
    a word that is as likely as words usually are."""
    if _LOST in word:
        g = _lost_gain(lm, word)
        lost = [(word, g, [("lost", "")])] if g > 0 else []
    else:
        lost = []
    raw = lm.loglik(word)
    if raw >= -5.5 * _odd_pairs(word):
        return lost or None
    found: dict[str, list] = {}

    def weigh(start: str, base: float) -> Iterator[tuple[str, str, str, float]]:
        for page, true, fixed in _readings(start):
            v = lm.loglik(fixed)
            if v > raw and v > -9.0 * max(1, _odd_pairs(fixed)):
                yield page, true, fixed, v - raw

    for page, true, fixed, gain in weigh(word, raw):
        found.setdefault(fixed, [gain, []])[1].append((page, true))
    fixed, (gain, pages) = max(found.items(), key=lambda x: (x[1][0], x[0]), default=("", (0.0, [])))
    again = fixed
    for _ in range(2 if any(true == "utf-8" for _, true in pages) else 0):  # garbled more than once: the last swap names the pair
        if again.isascii() or lm.loglik(again) >= -5.5 * _odd_pairs(again):
            break
        more = max(weigh(again, raw), key=lambda x: (x[3], x[2]), default=None)
        if more is None or more[3] <= gain:
            break
        again, gain = more[2], more[3]
    if again != fixed and again not in found:
        found[again] = [gain, list(pages)]
        found[fixed][1].clear()
    return lost + [(fixed, gain, pages) for fixed, (gain, pages) in found.items() if pages]


def readings(words: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """E-step per distinct word: ``word, fixed, gain, pages, open``; pairs of pages that change it alike are one row. A
    suspicious word that no pair explains has one row with ``open`` true."""
    shared = words.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, counts = shared.value
        lm = Bigrams(slots.astype(np.int64), counts.astype(np.float64))
        for batch in batches:
            out = []
            for w in batch.column(0).to_pylist():
                rows = word_readings(lm, w)
                if rows is None:
                    continue
                best = max((g for _, g, _ in rows), default=0.0)
                out += [(w, fixed, gain, pages, False) for fixed, gain, pages in rows]
                if best < 2.0 and _may_swap(w):
                    out.append((w, w, 0.0, [], True))
            cols = list(zip(*out)) or [[], [], [], [], []]
            pages = [[{"page": p, "true": t} for p, t in ps] for ps in cols[3]]
            kinds = [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("page", pa.string()), ("true", pa.string())])), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip([cols[0], cols[1], cols[2], pages, cols[4]], kinds)], names=["word", "fixed", "gain", "pages", "open"])

    return words.select("word").mapInArrow(run, _READING)


# -- free start: ciphers of pages that are not known ------------------------------------------------------------------
#: Alphabets that single-byte pages are made for.
ALPHABETS = {"latin": r"[a-zA-Z\u00c0-\u024f]", "greek": r"[\u0386-\u03ce]", "cyrillic": r"[\u0400-\u045f\u0490-\u0491]", "hebrew": r"[\u05d0-\u05ea]", "arabic": r"[\u0621-\u064a]"}


def solve(pairs: dict[tuple[str, str], float], lm: Bigrams, alphabet: str, restarts: int = 8) -> tuple[dict[str, str], float]:
    """The mapping of the odd characters in the bigram counts ``pairs`` to letters of an alphabet, and its gain in nats.

    Expectation-maximisation on the table of the cipher: each character holds a distribution over letters, which is
    re-estimated from those of its neighbours and the bigrams of the language, one letter for one character, while a
    temperature falls; exchanges of two letters that raise the likelihood end it, and the best start wins. Counts of pairs are all it needs, so its size is that of
    the alphabet and not of the text.
    """
    symbols = sorted({c for p in pairs for c in p if c > "\x7f"})
    fixed = sorted({c for p in pairs for c in p if c <= "\x7f"})
    known = re.compile(ALPHABETS[alphabet])
    one = lambda cs: np.array([ord(c) for c in cs], np.uint32)
    uni = lambda cs: lm.table[_slots(one(cs), np.zeros(len(cs), np.uint32))]
    letters = [c for c in map(chr, range(65, 0x650)) if known.match(c)]
    letters = [c for c, n in zip(letters, uni(letters)) if n >= lm.rare]
    if len(letters) < 8 or not 0 < len(symbols) <= 128:  # a page of one byte has no more
        return {}, 0.0

    def table(a: list[str], b: list[str]) -> np.ndarray:
        x, y = np.repeat(one(a), len(b)), np.tile(one(b), len(a))
        p = (lm.table[_slots(x, y)] + lm.floor) / (np.repeat(uni(a), len(b)) + lm.rare)
        return np.log(np.minimum(p, 1.0)).reshape(len(a), len(b))

    at_s, at_f = {c: i for i, c in enumerate(symbols)}, {c: i for i, c in enumerate(fixed)}
    ss, fs, sf = np.zeros((len(symbols), len(symbols))), np.zeros((len(fixed), len(symbols))), np.zeros((len(symbols), len(fixed)))
    for (a, b), n in pairs.items():
        if a in at_s and b in at_s:
            ss[at_s[a], at_s[b]] += n
        elif b in at_s:
            fs[at_f[a], at_s[b]] += n
        elif a in at_s:
            sf[at_s[a], at_f[b]] += n
    ll, fl, lf = table(letters, letters), table(fixed, letters) if fixed else np.zeros((0, len(letters))), table(letters, fixed) if fixed else np.zeros((len(letters), 0))
    own = table(symbols, symbols), table(fixed, symbols) if fixed else np.zeros((0, len(symbols))), table(symbols, fixed) if fixed else np.zeros((len(symbols), 0))
    before = float((ss * own[0]).sum() + (fs * own[1]).sum() + (sf * own[2]).sum())
    border = fs.T @ fl + sf @ lf.T
    weight = ss.sum(0) + ss.sum(1) + fs.sum(0) + sf.sum(1)
    seen, usual = np.log(weight / weight.sum() + 1e-9), np.log(uni(letters) / uni(letters).sum() + 1e-9)

    def score(m: np.ndarray) -> float:
        return float((ss * ll[np.ix_(m, m)]).sum() + border[np.arange(len(m)), m].sum())

    rng, best, most, size = np.random.default_rng(7), None, -np.inf, max(len(symbols), len(letters))
    for k in range(restarts):
        near = -np.abs(seen[:, None] - usual[None, :])
        q = np.exp(near + (rng.normal(0, 1, near.shape) if k else 0))
        heat = max(1.0, weight.mean())
        while heat > 0.2 * max(1.0, weight.mean()) ** 0.25:
            for _ in range(4):
                v = (ss.T @ (q @ ll) + ss @ (q @ ll.T) + border) / heat
                full = np.full((size, size), 1e-9)  # symbols without letter and letters without symbol
                full[: len(symbols), : len(letters)] = np.exp(np.maximum(v - v.max(1, keepdims=True), -60))
                for _ in range(15):  # one letter for one symbol
                    full /= full.sum(1, keepdims=True)
                    full /= full.sum(0, keepdims=True)
                q = 0.3 * q + 0.7 * full[: len(symbols), : len(letters)]
            heat *= 0.75
        m, free = np.full(len(symbols), -1), set(range(len(letters)))
        for at in np.argsort(-q, axis=None):
            i, x = divmod(int(at), len(letters))
            if m[i] < 0 and x in free:
                m[i] = x
                free.discard(x)
        m[m < 0] = 0
        value, moved = score(m), True
        while moved:  # exchanges of two letters, used or not
            moved = False
            for i in range(len(symbols)):
                for x in range(len(letters)):
                    if x == m[i]:
                        continue
                    t = m.copy()
                    t[m == x] = m[i]
                    t[i] = x
                    if (v := score(t)) > value + 1e-9:
                        m, value, moved = t, v, True
        if value > most:
            best, most = m, value
    return {c: letters[i] for c, i in zip(symbols, best)}, most - before


def free_mappings(occurrences: DataFrame, open_words: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``source, alphabet, seen, letters``: mappings learned without a known page, two strings for ``translate``.

    ``occurrences`` has ``source, word, n``, ``open_words`` the words that no page explains. Only counts of pairs of
    characters per source go on, combined on the map side: as many as an alphabet has pairs, however large the source.
    """
    shared = occurrences.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32)))
    single = open_words.where(~F.col("word").rlike(r"[\x{2E80}-\x{D7FF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]")).select("word").distinct()
    words = occurrences.join(single, "word").groupBy("source", "word").agg(F.sum("n").alias("n"))
    chars = F.split(F.concat(F.lit(" "), F.regexp_replace("word", "[0-9]", "0"), F.lit(" ")), "")
    pair = words.select("source", "n", F.explode(F.arrays_zip(F.slice(chars, F.lit(1), F.size(chars) - 1).alias("a"), F.slice(chars, F.lit(2), F.size(chars) - 1).alias("b"))).alias("p"))
    pair = pair.select("source", "p.a", "p.b", "n").where(r"a rlike '[^\\x00-\\x7F]' or b rlike '[^\\x00-\\x7F]'").groupBy("source", "a", "b").agg(F.sum("n").alias("n"))
    enough = pair.groupBy("source").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST_SYMBOLS).select(F.col("source").alias("_s"))
    pair = pair.join(enough, F.col("source").eqNullSafe(F.col("_s")), "left_semi")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        slots, counts = shared.value
        lm = Bigrams(slots.astype(np.int64), counts.astype(np.float64))
        pairs = {(a, b): float(n) for a, b, n in zip(rows["a"], rows["b"], rows["n"])}
        tried = [(alphabet, *solve(pairs, lm, alphabet)) for alphabet in ALPHABETS]
        alphabet, mapping, gain = max(tried, key=lambda t: t[2])
        good = mapping and gain >= COST * len(mapping)
        return pd.DataFrame({"source": rows["source"].head(1) if good else [], "alphabet": [alphabet] if good else [], "seen": ["".join(mapping)] if good else [], "letters": ["".join(mapping.values())] if good else []})

    return pair.groupBy("source").applyInPandas(run, "source string, alphabet string, seen string, letters string")


def free_readings(occurrences: DataFrame, mappings: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``source, word, fixed, gain, pages`` of the suspicious words that a learned mapping makes likelier; ``translate`` applies it."""
    shared = occurrences.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32)))
    words = occurrences.select("source", "word").distinct()
    m = mappings.select(F.col("source").alias("_s"), "alphabet", "seen", "letters")
    read = words.join(m, F.col("source").eqNullSafe(F.col("_s"))).select("source", "word", F.expr("translate(word, seen, letters)").alias("fixed"), "alphabet")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, counts = shared.value
        lm = Bigrams(slots.astype(np.int64), counts.astype(np.float64))
        for batch in batches:
            gain = [lm.loglik(f) - lm.loglik(w) for w, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gain, pa.float64())], names=["source", "word", "fixed", "alphabet", "gain"])

    out = read.mapInArrow(run, "source string, word string, fixed string, alphabet string, gain double").where("gain > 0")
    return out.select("source", "word", "fixed", "gain", F.array(F.struct(F.lit("learned").alias("page"), F.col("alphabet").alias("true"))).alias("pages"))


# -- texts ------------------------------------------------------------------------------------------------------------
def shares(post: DataFrame) -> DataFrame:
    """M-step over the mixture of ciphers: ``_s, _p, _u, share`` of each source and pair of pages from the posteriors ``post`` of
    the texts (``doc, source, page, true, post``), smoothed with the shares over all sources."""
    part = post.groupBy(F.col("source").alias("_s"), F.col("page").alias("_p"), F.col("true").alias("_u")).agg(F.sum("post").alias("here"))
    total = part.groupBy(F.col("_s").alias("_t")).agg(F.sum("here").alias("total"))
    overall = part.groupBy(F.col("_p").alias("_q"), F.col("_u").alias("_v")).agg(F.sum("here").alias("w"))
    grand = overall.agg(F.sum("w").alias("grand"))  # one row
    both = part.join(total, F.col("_s").eqNullSafe(F.col("_t"))).join(overall, (F.col("_p") == F.col("_q")) & (F.col("_u") == F.col("_v"))).crossJoin(F.broadcast(grand))
    return both.select("_s", "_p", "_u", ((F.col("here") + PRIOR * F.col("w") / F.col("grand")) / (F.col("total") + PRIOR)).alias("share"))


def with_shares(gains: DataFrame, share: DataFrame | None) -> DataFrame:
    """E-step over the mixture: ``post`` of each cipher of a text at the given shares (None: all alike)."""
    if share is None:
        return _posterior(gains.withColumn("v", F.col("gain")))
    scored = gains.join(share, F.col("source").eqNullSafe(F.col("_s")) & (F.col("page") == F.col("_p")) & (F.col("true") == F.col("_u")), "left")
    least = F.lit(1e-6)  # of a pair of pages that its source had not shown before
    return _posterior(scored.select("doc", "source", "page", "true", "gain", (F.col("gain") + F.log(F.coalesce("share", least))).alias("v")))


def _posterior(scored: DataFrame) -> DataFrame:
    top = scored.groupBy(F.col("doc").alias("_o")).agg(F.collect_list(F.struct("page", "true", "source", "gain", "v")).alias("all"))  # as many as there are pairs of pages
    e = top.select(F.col("_o").alias("doc"), F.array_max(F.transform("all", lambda x: x.v)).alias("m"), "all")
    e = e.select("doc", "all", "m", F.aggregate("all", F.lit(0.0), lambda z, x: z + F.exp(x.v - F.col("m"))).alias("z"))
    return e.select("doc", "m", "z", F.explode("all").alias("x")).select("doc", "x.source", "x.page", "x.true", "x.gain", (F.exp(F.col("x.v") - F.col("m")) / F.col("z")).alias("post"))


def _rounds(docs: DataFrame, key: str, text: str, source: str):
    """The rounds of the operator, until two find the same texts: the texts with odd characters, the words of these, the
    readings of the suspicious ones in place, the gains of each cipher over the margin, the shares and the language."""
    slim = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    slim = slim.select(F.struct("key", F.xxhash64("text").alias("h")).alias("doc"), "source", "text")
    total = materialise(word_counts(docs, text))
    # Words are few bytes and much work: dealt out to all tasks, whatever their size.
    odd = total.where(F.col("word").rlike(r"[^\x00-\x7F]")).select("word").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    occurring = slim.select("doc", "source", F.explode(F.split("text", r"[ \t\r\n]+")).alias("word")).where(F.col("word").rlike(r"[^\x00-\x7F]"))
    model, before, share = bigram_counts(total), None, None
    weight = F.col("gain") * (1 + F.log("n"))
    while True:
        read = materialise(readings(odd, model))
        suspicious = read.select("word").distinct()
        held = suspicious.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
        placed = materialise(occurring.join(F.broadcast(suspicious) if held <= SENT_BYTES else suspicious, "word").groupBy("doc", "source", "word").agg(F.count("*").alias("n")))
        known = placed.join(read.where(~F.col("open")), "word").select("doc", "source", "word", "n", "fixed", "gain", "pages")
        open_words = read.where("open")
        mappings = materialise(free_mappings(placed, open_words, model))
        if not mappings.isEmpty():
            free = materialise(free_readings(placed, mappings, model)).select(F.col("source").alias("_s"), F.col("word").alias("_w"), "fixed", "gain", "pages")
            more = placed.join(free, (F.col("word") == F.col("_w")) & F.col("source").eqNullSafe(F.col("_s"))).select("doc", "source", "word", "n", "fixed", "gain", "pages")
            known = known.unionByName(more)
        known = materialise(known)
        pairs = known.select("doc", "source", F.explode("pages").alias("p"), weight.alias("gain"))
        gains = materialise(pairs.groupBy("doc", "source", "p.page", "p.true").agg(F.sum("gain").alias("gain")).where(F.col("gain") >= MARGIN))
        dirty = gains.select("doc").distinct()
        now = dirty.agg(F.count("*"), F.sum(F.hash("doc").cast("long"))).first()
        if now == before:
            return occurring, slim, known, gains, share, model, mappings
        before = now
        share = materialise(shares(with_shares(gains, share)))
        out = known.select("doc", "word", "n").distinct().join(dirty, "doc").groupBy("word").agg(F.sum("n").alias("out"))
        model = bigram_counts(total.join(out, "word", "left").select("word", (F.col("n") - F.coalesce("out", F.lit(0))).alias("n")), first=False)


def garbled_keys(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key`` of the garbled documents, each once, without restoring them."""
    gains = _rounds(docs, key, text, source)[3]
    return gains.select(F.col("doc.key").alias(key)).distinct()


def garbled_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key, source, page, true, gain, text, words`` of the garbled documents. ``text`` is restored unless ``page`` is
    ``lost``; ``words`` are the words changed, with what they became."""
    occurring, slim, known, gains, share, model, mappings = _rounds(docs, key, text, source)
    post = with_shares(gains, share)
    best = post.groupBy("doc", "source").agg(F.max_by(F.struct("page", "true", "gain"), F.struct(F.round("post", 6), "gain", -F.array_position(F.lit([*READ_SINGLE, *READ_MULTI]), F.col("page")), "true")).alias("b")).select("doc", "source", "b.*")
    best = materialise(best)
    spelled = known.select("doc", "word", "fixed", F.explode("pages").alias("p")).select("doc", "word", "fixed", "p.page", "p.true").join(best.select("doc", "page", "true"), ["doc", "page", "true"]).select("doc", "word", "fixed")
    rest = occurring.join(best.select("doc", "page", "true"), "doc").select("doc", "page", "true", "word").distinct().join(spelled.select("doc", "word"), ["doc", "word"], "left_anti")
    free = rest.where("page = 'learned'").join(best.select("doc", "source"), "doc").join(mappings.select(F.col("source").alias("_s"), "seen", "letters"), F.col("source").eqNullSafe(F.col("_s")))
    free = free.select("doc", "word", F.expr("translate(word, seen, letters)").alias("fixed")).where("fixed <> word")
    changed = spelled.unionByName(applied(rest, model)).unionByName(free).groupBy("doc").agg(F.map_from_entries(F.collect_set(F.struct("word", "fixed"))).alias("words"))
    full = best.join(changed, "doc").join(slim.select("doc", "text").dropDuplicates(["doc"]), "doc")
    return _restored(full.select(F.col("doc.key").alias(key), "source", "page", "true", "gain", "text", "words"))


def applied(words: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc, word, fixed``: the table of a text's cipher applied to its other words (``doc, page, true, word``), which alone were
    no evidence, where the result is likelier than the word or was valid in a page of several bytes."""
    shared = words.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32)))
    kind = words.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, counts = shared.value
        lm = Bigrams(slots.astype(np.int64), counts.astype(np.float64))
        for batch in batches:
            at, out = [], []
            for i, (page, true, w) in enumerate(zip(batch.column("page").to_pylist(), batch.column("true").to_pylist(), batch.column("word").to_pylist())):
                fixed = swapped(w, page, true)
                if fixed and fixed != w and (true == "utf-8" or lm.loglik(fixed) > lm.loglik(w)):
                    at.append(i)
                    out.append(fixed)
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at, pa.int64())), batch.column("word").take(pa.array(at, pa.int64())), pa.array(out, pa.string())], names=["doc", "word", "fixed"])

    return words.where(~F.col("page").isin("lost", "learned") & (F.col("true") != "utf-8 twice")).mapInArrow(run, f"doc {kind}, word string, fixed string")


def swapped(word: str, page: str, true: str) -> str | None:
    """The word's bytes in one page read in another; None if they are none of it."""
    raw = _to_bytes(word, page)
    if raw is None or raw.isascii():
        return None
    try:
        fixed = raw.decode(true)
    except UnicodeDecodeError:
        return None
    return fixed if _ONE_SCRIPT(fixed) else None


def _restored(found: DataFrame) -> DataFrame:
    """``text`` with its changed words replaced by what they became."""
    word = re.compile(r"[^ \t\r\n]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for t, pairs in zip(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("words")).to_pylist()):
                table = dict(pairs)
                texts.append(word.sub(lambda m, table=table: table.get(m.group(), m.group()), t))
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return found.mapInArrow(run, found.schema)


def learned_mapping(found: DataFrame) -> DataFrame:
    """The byte-to-letter mapping learned per source, for ciphers of one character for one: expected counts of each pair."""
    single = ~F.col("true").isin(*_MULTI_BYTE) & ~F.col("page").isin(*READ_MULTI, "lost")
    w = found.where(single).select("source", "page", "true", F.explode("words").alias("word", "fixed")).where("length(word) = length(fixed)")
    p = w.select("source", "page", "true", F.explode(F.arrays_zip(F.split("word", "").alias("seen"), F.split("fixed", "").alias("letter"))).alias("p"))
    return p.where("p.seen <> p.letter").groupBy("source", "page", "true", "p.seen", "p.letter").agg(F.count("*").alias("n"))
