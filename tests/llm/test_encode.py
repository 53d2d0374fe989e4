"""Encoding by tree reduction equals encoding at once, round trips, and keeps its defined results."""

import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeplane.llm import encode as E


@pytest.fixture(scope="module")
def whole():
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, E.rank_file().splitlines())}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=table, special_tokens={})


PARTS = ["'", "s", "l", "ll", "re", " ", "  ", "\n", "\t", "a", "é", "１", "7", " ", "\x1c", "\x85", "!", "​", "😀", "d", "v", "漢字", "word", "'ve", "<|endoftext|>", "é", "   x"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
def test_small_leaves_equal_whole_text(whole, text):
    e = _small()
    assert e.encode(text) == whole.encode_ordinary(text)
    assert e.decode(e.encode(text)) == text


def _small(cache={}):
    if "e" not in cache:
        cache["e"] = E.Encoder(E.rank_file(), leaf_chars=3)
    return cache["e"]


def test_long_texts(whole):
    for text in (" " * 5000, "a" * 7000, "x y" * 4000, "'" * 3000 + "ll", "日本語の文章。" * 900, "\n \n" * 2000 + "end"):
        e = E.Encoder(E.rank_file(), leaf_chars=64)
        assert e.encode(text) == whole.encode_ordinary(text)


def test_table(spark, whole):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "it's — fine", "x"), (4, "it's — fine", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in E.encode_texts(df).collect())
    assert got == sorted((k, whole.encode_ordinary(t) if t else []) for k, t, _ in rows)
    back = {r.doc_id: r.text for r in E.decode_ids(E.encode_texts(df)).collect()}
    assert back == {1: "Hello world", 2: "", 3: "", 4: "it's — fine"}
    assert E.encode_texts(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
