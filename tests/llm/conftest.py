import random

import pytest

LONG = 60_000
WORDS = {
    "en": "the of and to in that is was for with ing tion her over under light house water stone garden winter",
    "fr": "le la les des une dans pour avec sur été maison lumière jardin hiver où déjà leçon garçon eau ciel",
    "de": "der die das und nicht für mit über größe straße wasser garten winter licht haus schön wählen stein",
}


def prose(rng, n, lang="en"):
    pool = WORDS[lang].split()
    return " ".join(rng.choice(pool) + rng.choice(["", "", "", rng.choice(pool)]) for _ in range(n))


@pytest.fixture(scope="session")
def prose_of():
    return prose


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rng = random.Random(3)
    long = prose(rng, LONG // 6)
    texts = [None, "", " \n\t ", "one", long, long, prose(rng, 40), prose(rng, 40), "a\nb\na\n", "日本語 のテキスト\n" + prose(rng, 30, "fr"), "#" * 500, None]
    ids = list(range(len(texts)))
    ids[-1] = None
    rows = [(i, t, None if i == 3 else "en", "s", len(t or ""), 1, "x", 2.0, "k", 5, [1]) for i, t in zip(ids, texts)]
    rows.append(rows[6])  # repeated row
    rows.append((7, "same id, other text " + prose(rng, 30), "de", None, 0, 1, "x", 2.0, "k", 5, [1]))
    schema = "doc_id long, text string, lang string, source string, n_chars long, n long, kept string, score double, row string, shard int, at array<int>"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
