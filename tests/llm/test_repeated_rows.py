"""Copies of a row: bounded samples, no lost rows, no wrong ids."""
import random

import pytest

from gridloom.llm import language_id, line_dedup, packing, quality_classifier, samples, toxicity
from gridloom.llm.tokens import Encoder, public_path

SF = "/root/testdata/sf0.001"
COPIES = 1000


@pytest.fixture(scope="module")
def copied(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    first = docs.where("length(text) < 2000").orderBy("doc_id").limit(1)
    return docs.unionByName(first.selectExpr("explode(array_repeat(struct(*), %d)) AS r" % COPIES).select("r.*"))


def test_one_text_per_id(spark, copied):
    ids = copied.select("doc_id")
    picked = samples.pick(ids, samples.distinct_ids(ids), 150, seed=2)
    assert picked.count() == picked.distinct().count() <= 150
    got = samples.gather(copied, picked.selectExpr("doc_id", "'u' AS kind"), {"u": 150})
    assert 100 < len(got["u"]) <= 150


def test_limit_is_asserted(spark, copied):
    picked = copied.selectExpr("doc_id", "'u' AS kind").distinct()
    with pytest.raises(AssertionError):
        samples.gather(copied, picked, {"u": 10})


@pytest.mark.parametrize("module, folds, held", [(toxicity, 3, 1), (quality_classifier, 4, 2)])
def test_classifiers_learn_as_without_copies(spark, copied, module, folds, held, monkeypatch):
    seen = []
    train = module.train
    monkeypatch.setattr(module, "train", lambda p, u, n, prior: seen.append((len(p), len(u), len(n))) or train(p, u, n, prior))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    many = module.score_documents(copied, labels, folds=folds, held=held)
    module.score_documents(copied.distinct(), labels, folds=folds, held=held)
    assert seen[0] == seen[1]
    assert many.count() == copied.count()


def test_language_rows_are_bounded(spark, copied, monkeypatch):
    seen = []
    train = language_id.train
    monkeypatch.setattr(language_id, "train", lambda t, y: seen.append(len(t)) or train(t, y))
    language_id.predict(copied)
    assert seen[0] <= copied.select("doc_id").distinct().count()
    junk = spark.range(400).selectExpr("id AS doc_id", "concat('some words here ', id) AS text", "concat('l', id) AS lang")
    monkeypatch.setattr(language_id, "LEARN_ROWS", 300)
    language_id.predict(junk)
    assert seen[1] <= language_id.LANGS


def test_signs_that_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "²", None), (2, "½ Ⅷ ①", None), (4, "abc", "en"), (5, "abd", "en"), (6, "é", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs).collect()}
    assert got[1] == got[2] == "und" and got[6] != "und"


def test_copies_lose_lines_once(spark):
    docs = spark.createDataFrame([(i, "shared\nown") for i in range(12)] + [(99, "shared\nmine")] * 50, "doc_id long, text string")
    kept, _ = line_dedup.dedup(docs, min_docs=10, by_id=True)
    got = [(r.n_lines, r.n_dropped, r.kept) for r in kept.where("_row.doc_id = 99").collect()]
    assert got == [(2, 1, "mine")] * 50


def test_copies_are_packed_each_for_itself(spark):
    docs = spark.createDataFrame([(1, "one two three")] * 300, "doc_id long, text string")
    got = packing.pack_documents(docs, public_path("word_bpe_49k.json"), capacity=16).collect()
    assert len(got) == 300 and len({(r.sequence_id, r.offset) for r in got}) == 300


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_rare_signs(name):
    enc = Encoder(public_path(name))
    rng = random.Random(6)
    signs = ["İ", "I", "ı", "ſ", "ẞ", "Σ", "ς", "ǅ", "Ⅷ", "Ⓐ", "é", "é", "̇", "K", "Å", " ", "!", "1", "½", "日", "a", "'S", "'ll", "\n", "\x85", "\xa0", "🙂", "<|", "ﬁ", "‍"]
    texts = ["İ! İstanbul."] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 14))) for _ in range(15000)]
    want = enc.tokenizer.encode_batch(texts, add_special_tokens=False)
    bad = [t for t, w in zip(texts, want) if enc.pack(t) != b"".join(i.to_bytes(4, "little") for i in w.ids)]
    assert bad == []
