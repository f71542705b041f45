import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import language_id, pu, quality_classifier, toxicity

BAD = ["idiot", "scum", "lowei"]


def test_risk_finds_the_mixed_in_class():
    """Positives and unlabelled rows only; the class prior lets the fit tell the hidden negatives."""
    rng = np.random.default_rng(0)

    p_pos, p_neg = np.array([0.9, 0.8, 0.7, 0.1, 0.5, 0.5]), np.array([0.1, 0.2, 0.3, 0.9, 0.5, 0.5])

    def draw(n, p):
        hits = [np.flatnonzero(rng.random(6) < p) for _ in range(n)]
        return hits

    def sets(hits):
        return pu.Sets(np.concatenate(([0], np.cumsum([len(h) for h in hits]))), np.concatenate(hits))

    weights, bias = pu.fit(sets(draw(500, p_pos)), sets(draw(300, p_pos) + draw(700, p_neg)), 0.3, 6)
    z = pu.margins(sets(draw(500, p_pos) + draw(500, p_neg)), weights, bias)
    assert ((z > 0) == (np.arange(1000) < 500)).mean() > 0.9


def test_cut_and_score():
    at, scale = pu.cut(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 0, 1, 1]))
    assert at == 1.5
    assert abs(pu.score(np.array([at]), at, scale)[0] - 0.7) < 1e-12
    assert pu.cut(np.zeros(3), np.ones(3, int)) == (0.0, 1.0)


def held(i, folds, rest):
    return zlib.crc32(str(i).encode()) % folds == rest


@pytest.fixture(scope="module")
def toxic(spark, prose_of):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        words = prose_of(rng, rng.randrange(30, 200), rng.choice(["en", "fr", "de"])).split()
        y = int(i % 6 == 0)
        for _ in range(4 * y):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ".", "x", "en"]))
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, y))
        elif y:
            labels.append((i, 1, y))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, c) for a, _, c in labels)


def test_toxicity_on_held_out_rows(toxic):
    docs, labels, truth = toxic
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 600
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    rows = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in rows) / len(rows) > 0.95
    assert sum(p for p, y in rows if y) >= 0.9 * sum(y for _, y in rows)


def test_held_out_labels_change_nothing(spark, toxic):
    docs, labels, _ = toxic
    turned = spark.createDataFrame([(r.doc_id, r.quality, 1 - r.toxic if held(r.doc_id, 3, 1) else r.toxic) for r in labels.collect()], labels.schema)
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score_documents(docs, x).collect()) for x in (labels, turned))
    assert a == b


@pytest.fixture(scope="module")
def graded(spark, prose_of):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(600):
        text = prose_of(rng, rng.randrange(30, 200)).capitalize() + "."
        kind = i % 12
        if kind == 1:
            text = text.upper().replace(" ", "!! ")
        elif kind == 2:
            text = " ".join(w + "***" for w in text.split())
        docs.append((i, text))
        labels.append((i, int(kind not in (1, 2)), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, b) for a, b, _ in labels)


def test_quality_on_held_out_rows(graded):
    docs, labels, truth = graded
    got = quality_classifier.score_documents(docs, labels).collect()
    assert len(got) == 600
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    rows = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
    assert sum(p == y for p, y in rows) / len(rows) > 0.95


@pytest.mark.parametrize("scorer", [toxicity, quality_classifier])
def test_classifiers_on_odd_rows(spark, scorer, odd_docs, no_docs, toxic, graded):
    labels = (toxic if scorer is toxicity else graded)[1]
    odd = labels.selectExpr("doc_id", "quality", "toxic", "'x' AS text", "1.0 AS score").unionByName(spark.createDataFrame([(None, 1, 1, "", 0.0), (4, None, None, None, None), (4, 0, 0, "", 0.0)], "doc_id long, quality int, toxic int, text string, score double"))
    got = scorer.score_documents(odd_docs, odd).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) <= 2
    assert scorer.score_documents(no_docs, odd).count() == 0
    assert len({r.score for r in scorer.score_documents(odd_docs, odd.limit(0)).collect()}) == 1


def test_codewords():
    for n in (2, 3, 4, 7, 8, 20):
        code = language_id.codewords(n)
        assert set(np.unique(code)) == {-1.0, 1.0}
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert apart >= {2: 1, 3: 2, 4: 4}.get(n, 5)


def test_language(spark, prose_of):
    rng = random.Random(9)
    docs = [(i, prose_of(rng, rng.randrange(5, 80), lang), None if i % 11 == 0 else lang) for i, lang in enumerate(["en", "fr", "de"] * 150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(frame).collect()}
    truth = {i: "en fr de".split()[i % 3] for i in range(450)}
    rows = [r.lang_pred == truth[i] for i, r in got.items() if r.held_out]
    assert sum(rows) / len(rows) > 0.97
    assert all(r.held_out == held(i, 4, 2) and 0 <= r.score <= 1 for i, r in got.items())
    lied = frame.selectExpr("doc_id", "text", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2 THEN 'xx' ELSE lang END AS lang")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(lied).collect()} == {i: r.lang_pred for i, r in got.items()}


def test_language_on_odd_rows(spark, odd_docs, no_docs):
    got = language_id.predict(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (0, 1, 2, 10)] == ["und"] * 4
    assert by[0].score == 0 and by[0].ambiguous
    assert language_id.predict(no_docs).count() == 0
    unknown = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predict(unknown).collect()} == {"und"}
