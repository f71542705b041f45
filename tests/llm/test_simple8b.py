import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import simple8b as S
from gridloom.llm.tokens import encoder, public_path

U64 = st.integers(0, 2**64 - 1)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.one_of(U64, st.integers(0, 50_256), st.integers(0, 1)), max_size=3000), st.integers(1, 40))
def test_round_trip(ids, times):
    ids = np.array(ids * (times if len(ids) < 100 else 1), np.uint64)
    words, blocks = S.encode(ids)
    assert (S.decode(words, len(ids), blocks) == ids).all()


def test_runs_and_escapes():
    ids = np.array([7] * 5000 + [2**63] * 3 + [1] * 10, np.uint64)
    words, blocks = S.encode(ids)
    assert len(words) < 40
    assert (S.decode(words, len(ids), blocks) == ids).all()


def test_one_block_decodes_alone():
    ids = np.arange(5000, dtype=np.uint64) * 11
    words, blocks = S.encode(ids)
    part = words[blocks[2] : blocks[3]]
    assert (S.decode(part, S.BLOCK, np.zeros(1, np.int64)) == ids[2 * S.BLOCK : 3 * S.BLOCK]).all()


def test_bad_chunk():
    with pytest.raises(ValueError):
        S.read_chunk(b"nope" + bytes(40))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_pieces_equal_the_library(name):
    enc = encoder(public_path(name))
    for text in ["", "a  b", "a\n\n b\t\tc  ", "I'M it's 'S IT'S dont' 'll", "naïve Ünï ½ ²3", "日本語 テスト, мир’s “q”", "é a", "<|endoftext|> x", "İstanbul'S ΑΣ", "a b   ​", "🙂🙂 ok", "12345 12a", " \n x", "a\r\nb\rc\x0bd\x1ce", "__x__ -- ##"]:
        assert np.frombuffer(enc.pack(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def check(docs, got, tokenizer):
    at = 0
    for (i, text), r in zip(docs, got):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert len(docs) == len(got)


def test_files(spark, odd_docs, no_docs, tmp_path):
    path = public_path("byte_bpe_50k.json")
    rows = odd_docs.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    docs = [(r.doc_id, r.text) for r in rows.orderBy("doc_id").collect()]
    check(docs, S.round_trip(spark.createDataFrame(docs, "doc_id long, text string"), path).orderBy("doc_id").collect(), encoder(path).tokenizer)
    assert S.round_trip(odd_docs, path).count() == odd_docs.count()
    assert S.round_trip(no_docs, path).count() == 0
    many = [(i, f"w{i} " * (i % 7)) for i in range(300)]
    S.write_files(spark.createDataFrame(many, "doc_id long, text string").repartition(5), path, 2, str(tmp_path / "f"), chunk_ids=40)
    check(many, S.read_files(spark, str(tmp_path / "f")).orderBy("doc_id").collect(), encoder(path).tokenizer)


def test_words_between_spaces_are_looked_up_whole():
    """One entry for a word with its signs; blanks beside a space are cut by the pattern; both as the library does."""
    enc = encoder(public_path("byte_bpe_50k.json"))
    for text in ["one word, two words. \"three\"", " lead", "trail ", "a \n b", "a\n b", "x\ty\nz it's 12a", "мир, año; naïve, 日本 ok", "tab\t end", "wide  sp", "don't can't", "a", " "]:
        assert np.frombuffer(enc.pack(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert "word," in enc.words and "" not in enc.words and not any(w[0].isspace() or w[-1].isspace() for w in enc.words)


def test_a_short_word_ends_at_its_block():
    """Widths rise right behind a block's end: the block's last word must not hold bits of the next block."""
    for tail in (1, 3, 59):
        ids = np.concatenate((np.ones(S.BLOCK - tail, np.uint64) * np.uint64(40_000), np.ones(tail, np.uint64), np.full(S.BLOCK, 2**59, np.uint64)))
        words, blocks = S.encode(ids)
        assert (S.decode(words, len(ids), blocks) == ids).all()
        assert len(words[blocks[0] : blocks[1]]) == len(S.encode(ids[: S.BLOCK])[0])
