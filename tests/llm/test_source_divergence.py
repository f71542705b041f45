import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from gridloom.llm import source_divergence as S
from gridloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, best):
    held, count, groups = Counter(), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(FOLD))
        groups.add((lang, source))
        count[lang, source].update(words)
        held.update((lang, w) for w in set(words))
    out = []
    for lang, source in groups:
        kept = sorted(w for (g, w), n in held.items() if g == lang and n >= min_docs)
        others = sorted(s for g, s in groups if g == lang)

        def share(c):
            total = sum(c[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 5) // total for w in kept}

        p = share(count[lang, source])
        whole = Counter()
        for s in others:
            whole.update(count[lang, s])
        q = share(whole)
        found = {"pair": [], "term": [(p[w] - q[w], w) for w in kept if count[lang, source][w] and p[w] > q[w]]}
        for s in others:
            if s != source:
                o = share(count[lang, s])
                found["pair"].append((sum(abs(p[w] - o[w]) for w in kept), s))
        for part, items in found.items():
            items.sort(key=lambda i: (-i[0], i[1].encode()))
            out += [(lang, source, part, w, v, i + 1) for i, (v, w) in enumerate(items) if part == "pair" or i < best]
    return sorted(out)


def corpus(spark, rows):
    return spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n long, term string")


def random_rows(n):
    rng = random.Random(4)
    words = [a + b for a in ("Ab", "é", "zz", "日", "the", "A_b", "x1y") for b in ("", "a", "Q", "ß", "-")]
    pick = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
    langs, sources = [None, "", "en", "de"], [None, "", "s1", "s2", "s3", "é"]
    return [(rng.choice(langs), rng.choice(sources), rng.choice([None, "", "123 \n", pick(), pick(), pick(), pick()])) for _ in range(n)] + [("only", "one", "a b c")] * 2 + [("dull", "s1", "1 2"), ("dull", "s2", None)]


def test_brute_force(spark):
    rows = random_rows(300)
    rows += rows[:20]  # repeated rows count again
    got = S.divergences(corpus(spark, rows), min_docs=5, best=6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 6)


def test_many_shards_blocks_and_merges(spark, monkeypatch):
    rows = random_rows(120)
    for name, value in (("SHARD_ROWS", 20), ("CELLS", 16), ("SLICE_BYTES", 64), ("HELD_ROWS", 30)):
        monkeypatch.setattr(S, name, value)
    assert sorted(map(tuple, S.divergences(corpus(spark, rows), min_docs=3, best=4).collect())) == brute(rows, 3, 4)


def test_shares_are_exact_for_large_counts():
    total = 8 * 10**15 + 12345
    count = [5, 10**15 + 7, 7 * 10**15, total]
    assert S.shares(np.array(count), total).tolist() == [1 + 10**9 * c // total for c in count]


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array(["s"] * 5), pa.array(["a" * 5_000_000, "", "b", "c" * 5_000_000, "d"])], names=["lang", "source", "text"])
    parts = list(S.text_slices(batch, 2, S.SLICE_BYTES))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 1


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES["op13_source_divergence"]).df()
    got = QUERIES["op13_source_divergence"](spark, SF)
    columns = got.columns
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in want[columns].itertuples(index=False))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, S.divergences(odd_docs, min_docs=2, best=5).collect())) == brute(rows, 2, 5)
    assert S.divergences(no_docs).count() == 0
