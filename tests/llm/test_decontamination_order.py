import random

from gridloom.llm import decontamination as D

from .test_decontamination import brute, rows, words


def test_moved_and_scattered_passages_are_found(spark):
    """Swapped halves, edits at even distances and short blocks in another order, against all windows."""
    rng = random.Random(5)
    items = [(i, words(rng, n)) for i, n in enumerate([104, 204, 64, 30, 9, 5])] + [(9, ["a", "b"] * 20)]
    docs = []
    for _, u in items:
        half, third = len(u) // 2, len(u) // 3
        even = list(u)
        for at in range(20, len(u), 45):
            even[at] = "changed"
        for p in (u[half:] + u[:half], u[third:] + u[:third], u[2 * third :] + u[third : 2 * third] + u[:third], even, u[: len(u) * 9 // 10]):
            docs.append((len(docs), " ".join(words(rng, 30) + p + words(rng, 40))))
            docs.append((len(docs), " ".join(p)))
    both, (_, u) = [(j, " ".join(u)) for j, u in items], items[0]
    assert brute([(0, " ".join(words(rng, 30) + u[52:] + u[:52] + words(rng, 30)))], both)[0, 0][2] > 0.9
    got = rows(D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(both, "item_id long, text string")))
    assert got == brute(docs, both)
    assert got[0, 0][2] > 0.9
