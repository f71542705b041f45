import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import packing as P
from gridloom.llm.tokens import encoder, public_path


def layout(counts, capacity):
    bins = {}
    for length, lo, hi, seq, per, offset in P.plan(counts, capacity):
        for r in range(lo, hi):
            bins.setdefault(seq + (r - lo) // per, []).append((offset + (r - lo) % per * length, length))
    return bins


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=25), st.just(60))
def test_plan_is_whole_and_gapless(counts, capacity):
    bins = layout(counts, capacity)
    placed = {}
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
            placed[length] = placed.get(length, 0) + 1
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in items) <= 2
    assert placed == {n: c for n, c in counts.items() if c}
    assert sorted(bins) == list(range(len(bins)))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), min_size=1, max_size=25))
def test_near_the_least(counts):
    """Best-fit decreasing needs at most 11/9 of the optimum and one more."""
    # Lower bounds of the optimum: the sum of lengths, and that at most k pieces over 1/(k+1) fit a bin.
    crowded = max(-(-sum(c for n, c in counts.items() if (k + 1) * n > 60) // k) for k in range(1, 6))
    least = max(-(-sum(n * c for n, c in counts.items()) // 60), crowded)
    assert len(layout(counts, 60)) <= 1.25 * least + 2


def test_plan_size_does_not_grow_with_counts():
    few = P.plan({n: 5 for n in range(1, 4097)}, 4096)
    many = P.plan({n: 5_000_003 for n in range(1, 4097)}, 4096)
    assert len(many) < 4 * len(few) + 4096


def test_documents(spark, odd_docs, no_docs):
    path = public_path("word_bpe_49k.json")
    enc = encoder(path)
    got = P.pack_documents(odd_docs, path, end_id=1, capacity=64).collect()
    want = []
    for r in odd_docs.collect():
        ids = enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for i, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((str(r.doc_id), i, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert P.pack_documents(no_docs, path).count() == 0


@pytest.mark.parametrize("n", [1, 7, 400])
def test_one_hot_length(spark, n):
    """All pieces have one length: ranks over buckets give every place once."""
    items = spark.range(n).selectExpr("id AS doc_id", "25L AS length")
    got = P.pack(items, 100, ["doc_id"], bucket_rows=10).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == n
    assert len({r.sequence_id for r in got}) == -(-n // 4)
