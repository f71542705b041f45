import random

import numpy as np
import pyarrow as pa

from gridloom.llm import partenum as P
from gridloom.llm.rows import map_texts, text_slices

from .test_partenum import brute, edited


def test_a_shared_passage_makes_no_pairs(spark, monkeypatch):
    """Documents that share most of their words with all others met on every signature inside the shared passage."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(100)]
    docs = [(i, " ".join([f"own{i}x{j}" for j in range(60)] + passage)) for i in range(120)]
    docs += [(1000 + i, " ".join(edited(rng, docs[i][1].split(" "), 2))) for i in range(0, 120, 10)]
    tried = []
    real = P._verify
    monkeypatch.setattr(P, "_verify", lambda pairs, *a: tried.append(pairs.count()) or real(pairs, *a))
    got = P.similar_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(docs, 4, 85, 100)
    assert sum(tried) < 2 * len(docs)


def test_common_shingles_come_last():
    order = P.Order(np.array([5, 9, 7]), np.array([40, 90, 40]))
    el = np.array([1, 5, 7, 9, 11], np.uint64) << np.uint64(32)
    assert (order.first(el, 5) >> np.uint64(32)).tolist() == [1, 11, 5, 7, 9]
    assert (P.Order(np.array([], np.int64), np.array([], np.int64)).first(el, 2) == el[:2]).all()


def test_a_batch_becomes_strings_slice_by_slice(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 600, None, "y" * 600, "", "z" * 3000])], names=["text"])
    assert [b.num_rows for b in text_slices(batch, 0, 1000)] == [3, 2]
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else " ".join(map(str, range(i)))) for i in range(50)], "doc_id long, text string")
    out = map_texts(rows, P._Sketch(1), "row long, n long, h1 long, h2 long, cells binary").collect()
    assert sorted((r.row, r.n) for r in out) == [(i, 0 if i % 3 == 0 else i) for i in range(50)]


def test_fewer_signatures_than_shingles():
    """At 0.8 a set of 390 shingles had 363 signatures, and their table filled the disk of the pipeline's third stage."""
    el = np.sort(np.random.default_rng(1).integers(0, 2**63, 390, dtype=np.uint64))
    sig, role = P.signatures(el, P.Scheme(80, 100))
    assert len(sig) == 79 and (role == P.STRONG).sum() == 44
