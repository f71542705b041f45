"""Language identification by error-correcting output codes.

Every learned language has a codeword of +1/-1 bits. One binary classifier per bit (logistic
regression on hashed byte trigrams of the folded text) predicts its bit; a text's distance to a
codeword is the logistic loss of its margins against the codeword's bits, weighted by how
reliable each bit was on the learning rows. The nearest codeword wins; where the runner-up is
nearly as near, the row is flagged as ambiguous.

Bound: the ``LANGS`` most common languages are learned, from at most ``PER_LANG`` rows each and about
``LEARN_ROWS`` in all, none longer than ``samples.LEARN_CHARS``; every row is scored over its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.rows import map_texts, text_rows
from gridloom.llm.samples import fold, texts_of
from gridloom.llm.textkit import lay_out

PER_LANG, SALTS = 800, 100
LANGS, LEARN_ROWS = 256, 8000
FOLDS, HELD = 4, 2
DIMS = 2048
AMBIGUOUS = 0.6
NO_LETTER = "und"

_LETTER = regex.compile(r"\p{L}")
_fold = np.full(256, 32, np.uint64)
_fold[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = [*range(ord("a"), ord("z") + 1), *range(128, 256)]


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of ``n`` classes: all distinct bits up to seven classes, else random ones that lie far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = np.arange(1, 1 << (n - 1))
        table = (bits[None, :] >> np.arange(n)[:, None]) & 1
        return np.where(table == 1, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(64):
        made = rng.choice([-1.0, 1.0], (n, 15 * int(np.ceil(np.log2(n)))))
        made = made[:, np.abs(made.sum(axis=0)) < n]  # a bit that is the same for all says nothing
        apart = (made.shape[1] - made @ made.T) / 2
        least = (apart + np.eye(n) * made.shape[1]).min()
        if least > far:
            best, far = made, least
    return best


def trigrams(texts: list[str]) -> np.ndarray:
    """Frequencies of hashed byte trigrams, one row per text, of length one."""
    buf, starts = lay_out([t.lower() for t in texts])
    b = _fold[buf]
    h = b[:-2] * np.uint64(0x9E3779B1) + b[1:-1] * np.uint64(0x85EBCA77) + b[2:] * np.uint64(0xC2B2AE3D)
    place = ((h ^ (h >> np.uint64(15))) % np.uint64(DIMS)).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(place)]
    empty = (b[:-2] == 32) & (b[1:-1] == 32)
    counts = np.bincount((row * DIMS + place)[~empty], minlength=len(texts) * DIMS).reshape(len(texts), DIMS).astype(np.float64)
    root = np.sqrt(counts)
    return root / np.maximum(np.linalg.norm(root, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # (DIMS, bits)
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword of each row and its share of the evidence."""
        f = x @ self.weights + self.bias
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None, :, :]) @ self.trust
        e = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        return loss.argmin(axis=1), e.max(axis=1) / e.sum(axis=1)


def train(texts: list[str], langs: list[str], rounds: int = 200, rate: float = 0.3, decay: float = 1e-5) -> Model:
    names = sorted(set(langs))
    code = codewords(len(names))
    bits = code.shape[1]
    if not names:
        return Model([], code, np.zeros((DIMS, bits)), np.zeros(bits), np.ones(bits))
    y = np.array([names.index(x) for x in langs])
    target = code[y]
    x = np.concatenate([trigrams(texts[i : i + 200]) for i in range(0, len(texts), 200)])
    # Every language counts the same, however many rows it has.
    share = (1.0 / np.bincount(y)[y] / len(names))[:, None]
    w, m, v = (np.zeros((DIMS + 1, bits)) for _ in range(3))
    for t in range(1, rounds + 1):
        f = x @ w[:-1] + w[-1]
        d = -target / (1 + np.exp(np.clip(target * f, -50, 50))) * share
        g = np.concatenate((x.T @ d + decay * w[:-1], d.sum(axis=0, keepdims=True)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    right = ((np.sign(x @ w[:-1] + w[-1]) == target) * share).sum(axis=0)
    trust = np.maximum(2 * right - 1, 0.01)
    return Model(names, code, w[:-1], w[-1], trust / trust.mean())


def predict(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous``, one row per input row.

    Texts that are null or have no letter get ``und`` with score 0, as do all texts when no language
    can be learned. ``lang`` is read only from rows of the learning folds; a repeated id is learned
    from once for each of its languages. Repeated rows get equal results. Equally near codewords go
    to the language that sorts first.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    ids = ids.distinct()
    common = ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "y").limit(LANGS)
    common = spark.createDataFrame([(r["y"],) for r in common.collect()], "y string")  # at most LANGS rows
    each = min(PER_LANG, max(1, LEARN_ROWS // max(1, common.count())))
    # A common language is dealt over salts; a task keeps a few rows per (language, salt).
    salted = ids.join(F.broadcast(common), "y").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy("y", "salt").orderBy(F.xxhash64("doc_id"), "doc_id"))
    few = salted.withColumn("rank", rank).where(F.col("rank") <= PER_LANG // SALTS)
    again = F.row_number().over(Window.partitionBy("y").orderBy("rank", F.xxhash64("doc_id"), "doc_id"))
    picked = few.select("doc_id", "y", again.alias("place")).where(F.col("place") <= each).select("doc_id", "y")
    sample = sorted(texts_of(docs, picked, "y").where(F.length("text") > 0).collect(), key=lambda r: (r["doc_id"], r["y"]))
    if len(sample) > each * LANGS:
        raise AssertionError(f"{len(sample)} learning rows")
    sample = [r for r in sample if _LETTER.search(r["text"])]
    model = train([r["text"] for r in sample], [r["y"] for r in sample])

    def run(keys: list, texts: list) -> dict:
        texts = [t or "" for t in texts]
        best, score = model.decode(trigrams(texts)) if model.langs else (np.zeros(len(texts), int), np.zeros(len(texts)))
        some = [bool(model.langs) and _LETTER.search(t) is not None for t in texts]
        score = np.where(some, score, 0.0)
        return {"doc_id": keys, "lang_pred": [model.langs[b] if s else NO_LETTER for b, s in zip(best, some)], "score": score, "ambiguous": score < AMBIGUOUS}

    scored = map_texts(text_rows(docs), run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")
