"""Pieces against the tokenizers library, packing against its own rules and the least possible number of sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tableloom.llm import packing
from tableloom.llm.bpe import read_definition
from tableloom.llm.queries import op12_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOOL = Tokenizer.from_file(PATH)
ENCODER = packing.Encoder(read_definition(PATH))


def expected(text, capacity=1024):
    ids = [*TOOL.encode(text or "", add_special_tokens=False).ids, 2]
    first = (len(ids) - 1) % capacity + 1
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        out.append((len(out), a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def check_places(rows, capacity=1024):
    """Sequences are gapless from 0 and within capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["<|endoftext|>", " ", "\n\n", "'s", "é", "42", "\x85", "　"]))))
def test_ids_equal_the_library(parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert ENCODER.ids(text).tolist() == TOOL.encode(text, add_special_tokens=False).ids


def test_other_files_use_their_own_rules():
    other = public_tokenizers.path("word_bpe_49k.json")
    text = "The quick brown fox's 42 Überläufer"
    assert packing.byte_ranks(__import__("json").loads(read_definition(other))) is None
    want = Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids
    assert packing.Encoder(read_definition(other)).ids(text).tolist() == want


def test_best_fit_by_hand():
    bins = packing.OpenSequences(10, 2)
    assert bins.put(6) == (0, 0)  # 4 free
    assert bins.put(7) == (1, 0)  # 3 free
    assert bins.put(3) == (1, 7)  # best fit is the fuller one
    assert bins.put(10) == (2, 0)  # a full one takes no place
    assert bins.put(5) == (3, 0) and bins.open == 2
    assert bins.put(8) == (4, 0)  # no fit: the fullest open one (4 free) closes
    assert bins.put(4) == (3, 5) and bins.put(2) == (4, 8)


def test_few_sequences():
    rng = random.Random(3)
    items = [rng.randint(1, 1024) for _ in range(20_000)]
    bins = packing.OpenSequences(1024, 4096)
    for at in range(0, len(items), 4096):
        for n in sorted(items[at : at + 4096], reverse=True):
            bins.put(n)
    low = max(-(-sum(items) // 1024), sum(n > 512 for n in items))
    assert bins.made <= 1.01 * low


def test_query_against_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = op12_packing(spark, sf).collect()
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, *p) for d in texts for p in expected(d.text))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    made = check_places(rows)
    low = -(-sum(r.length for r in rows) // 1024)
    assert made <= 1.02 * low + 1


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i * 7 % 90)) for i in range(60)], "doc_id bigint, text string")
    packed = packing.pack(packing.pieces(docs, PATH, capacity=64), capacity=64, places=4, stream_rows=25)
    rows = packed.collect()
    assert len({r.sequence_id >> packing.STREAM_BITS for r in rows}) > 1
    check_places(rows, 64)
    full = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert full[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids


def test_odd_rows(spark):
    long = "word " * 30_000
    rows = [(1, None, "a", 1), (2, "", "b", 2), (None, "no id", None, 3), (3, long, "c", 4), (4, "same", "d", 5), (4, "same", "d", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `Start` string, `a.b` int")
    out = packing.pack(packing.pieces(df, PATH, ids=None))
    assert out.columns == ["doc_id", "a.b", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = out.collect()
    want = sorted(str((r[0], r[3], *p)) for r in rows for p in expected(r[1]))
    assert sorted(str((r.doc_id, r["a.b"], r.piece, r.start, r.length, r.ids_crc32)) for r in got) == want
    check_places(got)
    assert packing.pack(packing.pieces(df.limit(0), PATH)).count() == 0
    odd = spark.createDataFrame([(None,), (0,), (-1,), (1025,), (5,)], "length int")
    found = {r.length: (r.sequence_id, r.offset) for r in packing.pack(odd).collect()}
    assert found[5] == (0, 0) and all(found[n] == (None, None) for n in (None, 0, -1, 1025))


@pytest.mark.parametrize("partitions", [1, 7])
def test_same_pieces_for_any_layout(spark, partitions):
    docs = spark.createDataFrame([(i, "a b c " * i) for i in range(200)], "doc_id bigint, text string")
    rows = packing.pack(packing.pieces(docs.repartition(partitions), PATH, ids=None)).collect()
    low = -(-sum(r.length for r in rows) // 1024)
    assert check_places(rows) <= low + 2
