import random
import re
from collections import Counter

from gridloom.llm import decontamination as D
from pyspark.sql import functions as F


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items, threshold=0.8):
    out = {}
    for i, t in docs:
        d = grams(t)
        for j, u in items:
            b = grams(u)
            if not b or not set(b) & set(d):
                continue
            best = None
            for at in range(max(len(d) - len(b), 0) + 1):
                a = d[at : at + len(b)]
                both = sum((Counter(a) & Counter(b)).values())
                sim = both / (len(a) + len(b) - both)
                if sim >= threshold and (best is None or sim > best[1]):
                    best = (at, sim)
            if best:
                out[i, j] = (len(b), *best)
    return out


def rows(found):
    return {(r.doc_id, r.item_id): (r.n_shingles, r.start, r.similarity) for r in found.collect()}


def words(rng, n, pool=4000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def test_matches_brute_force(spark):
    rng = random.Random(3)
    items = [(i, words(rng, n)) for i, n in enumerate([5, 6, 8, 9, 12, 13, 14, 20, 25, 26, 40, 60, 61, 90, 120, 200])]
    items += [(50, ["a", "b"] * 20), (51, ["x"] * 30), (52, items[8][1]), (53, ["one", "two"]), (54, [])]
    docs = []
    for j, (_, u) in enumerate(items):
        for edit in range(4):
            p = list(u)
            for _ in range(edit):  # words changed, added or lost anywhere
                at = rng.randrange(len(p) + 1)
                p[at : at + rng.randrange(2)] = words(rng, rng.randrange(2))
            docs.append((len(docs), " ".join(words(rng, rng.randrange(0, 60)) + p + words(rng, rng.randrange(0, 60)))))
        docs.append((len(docs), " ".join(u[: len(u) // 2] + words(rng, 20))))
    docs.append((len(docs), ("!! " + " - ".join(items[9][1]) + ".").upper()))
    items = [(i, " ".join(u)) for i, u in items] + [(99, None)]
    got = rows(D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items)
    assert len(got) > 30


def test_fingerprint_is_the_majority(spark):
    rng = random.Random(1)
    wins = [[rng.getrandbits(64) - 2**63 for _ in range(15)] for _ in range(50)]
    got = D._fingerprint(spark.createDataFrame([(i, w) for i, w in enumerate(wins)], "i int, w array<long>")).collect()
    for r in got:
        want = sum(1 << b for b in range(64) if sum(v >> b & 1 for v in wins[r.i]) >= 8)
        assert r.fp % 2**64 == want


def test_near_fingerprints_meet(spark):
    """Any two fingerprints within the radius share a block."""
    rng = random.Random(2)
    pairs = []
    for _ in range(100):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), D.RADIUS):
            b ^= 1 << bit
        pairs.append(tuple(v - 2**64 if v >= 2**63 else v for v in (a, b)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a long, b long").withColumn("size", F.lit(15))
    one, two = (D._blocks(df.select("i", "size", F.col(c).alias("fp"))).select("i", "key") for c in "ab")
    assert one.join(two, ["i", "key"]).select("i").distinct().count() == 100


def test_plan_has_no_python(spark, capsys):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    D.leaks(docs, items).explain("formatted")
    plan = capsys.readouterr().out
    assert "Join" in plan and not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.where("doc_id IS NOT NULL").collect()]
    items = [(1, docs[6][1]), (1, docs[6][1]), (2, None), (3, ""), (None, docs[7][1])]
    frame = spark.createDataFrame([(*x, "s") for x in items], "item_id long, text string, source string")
    found = D.leaks(odd_docs, frame)
    assert {(i, j) for i, j in rows(found)} == {(6, 1), (7, None)}
    assert D.leaks(no_docs, frame).count() == 0
    assert D.leaks(odd_docs, frame.limit(0)).count() == 0
