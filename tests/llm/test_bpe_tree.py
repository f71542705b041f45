import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from gridloom.llm import bpe_tree
from gridloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"
SIGNS = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "'s", "'re", "s", "1", "23", "日本", "ا", "#", "€", "\xa0", "　", "the", "ing", "aaaa", "The", "\x1c", "\x85", "İ", "🙂", "²", "\0"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return bpe_tree.RankBpe(PATH)


def unpack(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def check(bpe, library, text):
    ids = bpe.encode(text)
    assert unpack(ids) == library.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_fuzz(bpe, library):
    rng = random.Random(1)
    for _ in range(8000):
        check(bpe, library, "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30))))


def test_signs_of_all_planes(bpe, library):
    for c in [*range(0x3000), *range(0x3000, 0x110000, 37)]:
        if not 0xD800 <= c < 0xE000:
            check(bpe, library, f"x{chr(c)}y1{chr(c)} {chr(c)}\n{chr(c)}{chr(c)}  '{chr(c)}")


@pytest.mark.parametrize("text", ["a" * 30001, "ab" * 20000, "日" * 20000, "=" * 30000, " " * 80000, "\n" * 70001, "the" * 30000, ("word " * 9 + "\n \n") * 8000, "x" * 70000 + " y"])
def test_long_matches_and_blocks(bpe, library, text):
    check(bpe, library, text)


def test_join_of_any_two_halves(bpe):
    rng = random.Random(2)
    for _ in range(3000):
        data = bytes(rng.choice(b"abcdehinorst\xc3\xa9\xe6\x97\xa5") for _ in range(rng.randint(2, 40)))
        cut = rng.randint(0, len(data))
        assert bpe.join(bpe.merge(data[:cut]), bpe.merge(data[cut:])) == bpe.merge(data) == bpe.tree(data)


def test_short_and_long_merges_agree(bpe, monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"aabinghet  ") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    short = [bpe.merge(t) for t in texts]
    monkeypatch.setattr(bpe_tree, "SHORT_BYTES", 0)
    assert [bpe.merge(t) for t in texts] == short


def expected(library, rows):
    out = []
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_query(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op12_byte_bpe"](spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(library, rows)


def test_odd_rows(spark, library, odd_docs, no_docs):
    got = bpe_tree.round_trip(odd_docs)
    assert sorted(map(tuple, got.collect()), key=str) == expected(library, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert bpe_tree.round_trip(no_docs).count() == 0


def test_real_outputs(spark, odd_docs):
    back = bpe_tree.decode(bpe_tree.encode(odd_docs, PATH), PATH).collect()
    assert sorted(bytes(r.content) for r in back) == sorted((r.text or "").encode() for r in odd_docs.collect())
