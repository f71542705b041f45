import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import cuckoo
from gridloom.llm import line_dedup as L

ABC = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\r\x0b\x0c").translate(ABC)


def brute(docs, least):
    held = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or held[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(kept):
    rows = kept.select(F.col("_row.doc_id").alias("i"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("s"))
    return sorted(((r.i, r.n_lines, r.n_dropped, r.s) for r in rows.collect()), key=str)


def corpus(seed=2, n=120):
    rng = random.Random(seed)
    lines = ["", " ", "Same Line", " same line\t", "ÄÖ", "äö", " x", "x"] + [f"l{i}" for i in range(40)]
    return [(i, rng.choice([None, ""]) if i % 29 == 0 else "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 15)))) for i in range(n)]


def test_matches_brute_force(spark):
    docs = corpus()
    for least in (3, 10, 40):
        kept, _ = L.dedup(spark.createDataFrame(docs, "doc_id long, text string"), least)
        assert result(kept) == brute(docs, least)


def test_insert_and_delete(spark):
    """Taking documents back leaves the state of the rest, and the filters follow."""
    first, second = corpus(4, 60), [(i + 1000, t) for i, t in corpus(5, 60)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    state = L.update(None, df(first), 1, min_docs=12)
    assert result(L.drop_lines(df(first), state)) == brute(first, 12)
    both = L.update(state, df(second), 1)
    assert result(L.drop_lines(df(first + second), both)) == brute(first + second, 12)
    back = L.update(both, df(second), -1)
    assert sorted(map(tuple, back.counts.select("hi", "lo", "n_docs").collect())) == sorted(map(tuple, state.counts.select("hi", "lo", "n_docs").collect()))
    assert sum(r.n_keys for r in back.filters.collect()) == sum(r.n_keys for r in state.filters.collect())
    assert result(L.drop_lines(df(first), back)) == brute(first, 12)


def test_odd_rows(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    for least in (2, 10):
        kept, _ = L.dedup(odd_docs, least)
        assert result(kept) == brute(docs, least)
    assert kept.select("_row.*").columns == odd_docs.columns
    assert L.dedup(no_docs)[0].count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=400), st.integers(0, 2**32))
def test_cuckoo_filter(keys, seed):
    hi = np.array(sorted(keys), np.int64)
    lo = np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, len(hi), dtype=np.int64)
    f = cuckoo.Cuckoo.from_bytes(cuckoo.build(hi, lo).to_bytes())
    assert f.contains(hi, lo).all()
    f.delete(hi[::2], lo[::2])
    assert f.contains(hi[1::2], lo[1::2]).all()
    f.delete(hi[1::2], lo[1::2])
    assert not f.table.any()


def test_full_filter_is_rebuilt():
    same = np.zeros(9, np.int64)
    try:
        cuckoo.Cuckoo(9).insert(same, same)
    except cuckoo.Full:
        return
    raise AssertionError("nine equal keys fit eight slots")
