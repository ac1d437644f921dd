"""Encoding and decoding against the tokenizers library."""

import hashlib
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from tableloom.llm import bpe
from tableloom.llm.queries import bpe_digests, op7_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TOOL = Tokenizer.from_file(PATH)
PAIRS = bpe.BytePairs(bpe.read_definition(PATH))


def same(text: str) -> None:
    want = TOOL.encode(text, add_special_tokens=False).ids
    ids = PAIRS.encode(text)
    assert list(memoryview(ids).cast("I")) == want
    assert PAIRS.decode(ids) == TOOL.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", " ", "\n", "\x1c", "\x85", "'s", "12", "é", "é", "Σ", "İ", "<|",
                                 "<|endoftext|>", "<|startoftext|>", "|>", "###", "ung", "　", "ß"]), max_size=20))
def test_awkward_parts(parts):
    same("".join(parts))


def test_every_character_alone():
    for start in range(0, sys.maxunicode + 1, 64):
        chars = [chr(c) for c in range(start, min(start + 64, sys.maxunicode + 1)) if not 0xD800 <= c < 0xE000]
        same("a".join(chars))
        if start > 0x32000 and start < 0xE0000:
            break


def test_cuts_are_certain():
    for word in ("thbleonq", "zzxqjv", "überkeit"):
        mapped = PAIRS.pieces(PAIRS.normalize(word))[0][0]
        parts = PAIRS.cut(mapped)
        assert "".join(parts) == mapped + PAIRS.suffix
        assert all(a[-1] + b[0] not in PAIRS.inside for a, b in zip(parts, parts[1:]))
    assert len(PAIRS.cut("qzqxqz")) > 1


def test_small_memory_gives_the_same(monkeypatch):
    small = bpe.BytePairs(bpe.read_definition(PATH), cached=3)
    text = "the quick brown fox jumps over the lazy dog and the quick cat"
    assert small.encode(text) == PAIRS.encode(text)


def test_rows(spark):
    long = "word " * 50_000
    rows = [(1, "Hello", "x"), (2, None, "y"), (3, "", None), (1, "Hello", "x"), (4, long, "z"), (None, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe_digests(df).collect()
    assert len(out) == len(rows)
    for row in out:
        text = next(r[1] for r in rows if r[0] == row.doc_id) or ""
        enc = TOOL.encode(text, add_special_tokens=False)
        assert row.n_tokens == len(enc.ids)
        assert row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in enc.ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(TOOL.decode(enc.ids, skip_special_tokens=False).encode()).hexdigest()
    kept = bpe.encode(spark.createDataFrame([(1, "a", 5)], "`a.b` int, text string, ids int"), PATH)
    assert kept.columns == ["a.b", "ids"]
    back = bpe.decode(kept, PATH)
    assert [tuple(r) for r in back.collect()] == [(1, TOOL.decode(TOOL.encode("a").ids, skip_special_tokens=False))]
    assert bpe_digests(df.limit(0)).count() == 0


def test_query_against_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for row in op7_bpe(spark, sf).collect():
        ids = TOOL.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
