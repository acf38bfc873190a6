"""BPE (operator 1) against the tokenizer library, and packing (operator 4) against its limits."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from procurelake.llm.bpe import WordBpe, decode, encode, round_trip
from procurelake.llm.packing import Packer, op4_packing, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, encoding="utf-8") as f:
        return WordBpe(f.read())


def ids_of(bpe, text):
    return np.frombuffer(bpe.encode_texts([text])[0], "<u4").tolist()


TEXTS = [
    "", " ", "Hello, world's END", "naïve café ΑΣ ὈΔΥΣΣΕΎΣ İstanbul ẞ", "a\tb\nc d e　f\x85g", "x" * 300, "ab" * 5000 + " tail",
    "<|endoftext|> a<|startoftext|>b", "don't we'll I'm 12345 1/2 ²³ ٣", "emoji 👩‍👩‍👧 🇿🇦!!!", "é combining ﬁ", "​﻿ zero", "한국어 日本語 中文", "_under__score--dash...",
]


@pytest.mark.parametrize("text", TEXTS)
def test_matches_library(bpe, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = ids_of(bpe, text)
    assert got == want
    assert bpe.decode(np.array(got, np.int64)) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_matches_library(bpe, library, text):
    assert ids_of(bpe, text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text("abcdehilnorst", min_size=1, max_size=200))
def test_long_words_take_the_same_merges(bpe, text):
    """Matrix and list trees agree on any word."""
    symbols = [int(bpe.inner[b]) for b in text.encode()]
    symbols[-1] = int(bpe.last[text.encode()[-1]])
    assert bpe.merge_long(symbols) == ids_of(bpe, text)


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Same text", None), (3, "Same text", None), (None, "b " * 3000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode(df, tokenizer=PATH)
    assert out.columns == ["doc_id", "text", "ids"]
    got = out.collect()
    assert [len(r.ids) for r in got] == [0, 0, 2, 2, 3000] and got[2].ids == got[3].ids
    back = decode(out, tokenizer=PATH).collect()
    assert [r.decoded for r in back[:3]] == ["", "", "same</w> text</w>"]
    both = round_trip(df, tokenizer=PATH).collect()
    assert [r.decoded for r in both] == [r.decoded for r in back]
    empty = df.limit(0)
    assert encode(empty, tokenizer=PATH).count() == 0 and round_trip(empty, tokenizer=PATH).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [None, 99_999_999])], "k long, ids array<int>")
    assert [r.decoded for r in decode(odd, tokenizer=PATH).collect()] == ["", ""]


def place(examples, **limits):
    packer = Packer(limits.get("tokens", 16), limits.get("segments", 4), limits.get("loss", 16), window=limits.get("window", 5))
    rows = []
    for i, (n, prompt) in enumerate(examples):
        rows += packer.feed(i, n, prompt)
    return rows + list(packer.finish())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 30)), max_size=40), st.integers(1, 6), st.integers(1, 16))
def test_limits_hold(examples, segments, loss):
    rows = place(examples, segments=segments, loss=loss)
    for i, (n, _) in enumerate(examples):
        at = 0
        for _, start, length, *_ in sorted(r for r in rows if r[0] == i):
            assert start == at and length > 0
            at += length
        assert at == n
    for s in {r[4] for r in rows}:
        mine = sorted((r for r in rows if r[4] == s), key=lambda r: r[5])
        at = 0
        for r in mine:
            assert r[5] == at
            at += r[2]
        assert at <= 16 and len(mine) <= segments and sum(r[3] for r in mine) <= loss


def test_little_padding():
    """Without the other two limits, every sequence but the last is full."""
    rows = place([(n % 23 + 1, 0) for n in range(500)], segments=100, window=50)
    total = {}
    for r in rows:
        total[r[4]] = total.get(r[4], 0) + r[2]
    assert all(t == 16 or not t & (t - 1) for t in total.values())


def test_pack_frames(spark):
    rows = [(1, None, 7, 0), (2, b"", 7, None), (3, np.arange(20, dtype="<u4").tobytes(), 8, 5), (3, np.arange(20, dtype="<u4").tobytes(), 8, 5)]
    df = spark.createDataFrame(rows, "doc_id long, ids binary, start long, prompt int").coalesce(1)
    got = pack(df, max_tokens=8, prompt="prompt", end_id=1).collect()
    assert sum(r.length for r in got) == 1 + 1 + 21 + 21
    assert all(len(r.ids) == 4 * r.length for r in got)
    assert pack(df, max_tokens=8).where("doc_id < 3").count() == 0
    assert pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Packer(0, 1, 1)


def test_op4_holds_every_id(spark, library, tmp_path):
    texts = ["one two three " * 900, None, "", "short", "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op4_packing(spark, str(tmp_path)).collect()
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for r in (r for r in got if r.doc_id == i):
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert sum(r.length for r in got if r.doc_id == i) == len(ids)
