import random
import re

import numpy as np
import pytest

from gridloom.llm import partenum as P
from gridloom.llm.components import components

ABC = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ABC))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, k, num, den):
    sets = [shingle_set(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    best = {}
    for i, (d, _) in enumerate(docs):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted((d, len(sets[i]), best[find(i)]) for i, (d, _) in enumerate(docs))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"z{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"z{rng.randrange(10**6)}")
        elif len(words) > 2:
            del words[at]
    return words


def corpus(seed):
    rng = random.Random(seed)
    docs = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "one two three four"), (906, "É one two three four"), (907, "é one two three four")]
    for g in range(14):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 5, 9, 14, 25, 60, 200, 700]))]
        for _ in range(rng.randrange(1, 8)):
            base = edited(rng, base, rng.choice([0, 1, 1, 2, len(base) // 40, len(base) // 20])) if rng.random() < 0.7 else base
            docs.append((len(docs), " ".join(base)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("seed", "k", "num", "den"), [(1, 4, 85, 100), (2, 5, 80, 100), (3, 4, 85, 100), (4, 2, 1, 2)])
def test_matches_all_pairs(spark, seed, k, num, den):
    docs = corpus(seed)
    got = P.similar_classes(spark.createDataFrame(docs, "doc_id long, text string"), k, num, den).collect()
    assert sorted(map(tuple, got)) == brute(docs, k, num, den)


def test_linked_sets_share_a_signature():
    """The guarantee itself: random set pairs at the threshold, any size."""
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, n * 15 // 100 + 1)))
        add = int(rng.integers(0, max(1, n * 15 // 100 + 1)))
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            s = P.Scheme(85, 100)
            (x, rx), (y, ry) = P.signatures(a, s), P.signatures(b, s)
            _, i, j = np.intersect1d(x, y, return_indices=True)
            assert ((rx[i] != P.WEAK) | (ry[j] != P.WEAK)).any()


def test_a_large_group_makes_no_square_of_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    docs = [(i, " ".join(edited(rng, base, 1))) for i in range(250)]
    tried = []
    real = P._verify
    monkeypatch.setattr(P, "_verify", lambda pairs, *a: tried.append(pairs.count()) or real(pairs, *a))
    got = P.similar_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(tried) < 250 * 40


def test_odd_rows(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.where("doc_id IS NOT NULL").collect()]
    got = P.similar_classes(odd_docs.where("doc_id IS NOT NULL")).collect()
    assert sorted(map(tuple, got)) == brute(docs, 4, 85, 100)
    assert P.similar_classes(odd_docs).count() == odd_docs.count()
    assert P.similar_classes(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 300), (300, 400), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 400: 300, 500: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
