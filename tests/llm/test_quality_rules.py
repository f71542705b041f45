import random
import re
from collections import Counter

from gridloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")

    def covered(n):
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return {j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}

    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    chars = sum(map(len, w))
    failed = len(w) < 20 or 100 * len(covered(8)) > 30 * len(w)
    share = {n: sum(len(w[j]) for j in covered(n)) / max(chars, 1) for n in Q.COVER_LIMITS}
    return len(w), chars, sum(ch in "#*$%&|<>" for ch in text or ""), dup, len(covered(8)), failed, share


def texts():
    rng = random.Random(1)
    pool = "a bb ccc dddd é the the of | x#".split()
    out = [None, "", " ", "one two", "w " * 50]
    for _ in range(150):
        t = "".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "  ", "\t", "\x0b"]) for _ in range(rng.randrange(0, 120)))
        out.append(t + rng.choice(["", t, "\n" + t[: len(t) // 3]]))
    return out


def test_matches_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in Q.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n, chars, symbols, dup, repeat, failed, share = brute(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dup, repeat, failed)
        assert abs(r.dup_char_share - share[5]) < 1e-9
        if failed or any(share[k] > limit for k, limit in Q.COVER_LIMITS.items()):
            assert not r.kept


def test_clean_prose_stays_and_repetition_goes(spark, prose_of):
    rng = random.Random(5)
    clean = prose_of(rng, 400)
    rows = [(0, clean), (1, clean[:300] + "\n" + (clean[300:420] + "\n") * 6), (2, "buy now " * 60)]
    got = {r.doc_id: r.kept for r in Q.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_odd_rows(odd_docs, no_docs):
    got = Q.score_documents(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.base_failed and not r.kept for r in got if r.n_words == 0)
    assert Q.score_documents(no_docs).count() == 0
    kept = Q.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.kept for r in got)
    assert Q.keep_good(no_docs).count() == 0
