"""The pipeline's near-copy stage against brute force at its own rule: five words and a similarity of 0.8."""

import corpus_pipeline as C
import numpy as np
from gridloom.llm import partenum as P

from .test_partenum import brute as classes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def near_and_far():
    words = [f"w{i}" for i in range(104)]
    near = [*words[:50], "changed", *words[51:80], "again", *words[81:]]  # 90 of 110 shingles shared
    far = [*words[:20], "x", *words[20:50], "y", *words[50:80], "z", *words[80:]]  # 88 of 115
    return [" ".join(w) for w in (words, near, far)]


def test_near_copies_from_a_similarity_of_eight_tenths(spark):
    docs = list(enumerate(near_and_far(), 1))
    assert [c for _, _, c in classes(docs[:2], 5, 80, 100)] == [1, 1]
    assert [c for _, _, c in classes(docs[::2], 5, 80, 100)] == [1, 3]
    for some in (docs[:2], docs[::2]):
        want = sorted(d for d, _, c in classes(some, 5, 80, 100) if c == d)
        assert sorted(r.doc_id for r in C.near_copies(spark, spark.createDataFrame(some, SCHEMA), SF).collect()) == want


def test_linked_sets_share_a_signature_at_eight_tenths():
    rng, tried, s = np.random.default_rng(0), 0, P.Scheme(80, 100)
    for _ in range(400):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop, add = (int(rng.integers(0, n // 8 + 2)) for _ in range(2))
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            (x, rx), (y, ry) = P.signatures(a, s), P.signatures(b, s)
            _, i, j = np.intersect1d(x, y, return_indices=True)
            assert ((rx[i] != P.WEAK) | (ry[j] != P.WEAK)).any()
            tried += 1
    assert tried > 100


def test_rows_without_an_id_stay_unless_near_copies(spark):
    words, near, _ = near_and_far()
    other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "uv")
    rows = [(None, near), (5, words), (None, other), (None, other), (None, third), (7, third + " end"), (None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in C.near_copies(spark, frame, SF).collect()), key=str)
    assert got == sorted([(5, words), (None, other), (7, third + " end"), (None, None)], key=str)
    found = sorted(((r.doc_id, r.component_id) for r in P.similar_classes(frame, 5, 80, 100).collect()), key=str)
    assert found == sorted([(None, 5), (5, 5), (None, None), (None, None), (None, 7), (7, 7), (None, None)], key=str)


def test_a_leak_without_an_id_goes(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    frame = spark.createDataFrame([(None, item), (None, near_and_far()[0]), (3, item)], SCHEMA)
    assert [tuple(r) for r in C.benchmark(spark, frame, SF).collect()] == [(None, near_and_far()[0])]
