"""Quality scores by positive-unlabelled learning on style measures.

A text becomes a few dozen measures (shares of character kinds, word lengths, repetition), each cut
into bins at quantiles of unlabelled web text, so a text is a set with one bin per measure. Trusted
positives and unlabelled texts give the non-negative unbiased risk (``pu``); the class prior is
estimated from the labelled rows of the learning folds. Rows known to be poor serve only to place
the decision.

Bounds: at most ``POSITIVES``, ``UNLABELLED`` and ``POOR`` rows are learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import pu
from gridloom.llm.rows import bundles, map_texts, text_rows
from gridloom.llm.samples import clean_labels, distinct_ids, fold, gather, pick
from gridloom.llm.textkit import Hasher, is_blank, lay_out, mix, shingles, spans

POSITIVES, UNLABELLED, POOR = 4000, 8000, 3000
FOLDS, HELD = 4, 2
BINS = 24
KINDS = ["upper", "lower", "digit", "space", "line", "mark", "symbol", "pipe", "shout", "other", "high"]

_kind = np.full(256, KINDS.index("other"), np.int64)
for _name, _chars in (("mark", ".,;:'\"-()?"), ("symbol", "#*$%&<>@^~_=+\\/{}[]`"), ("pipe", "|"), ("shout", "!"), ("space", " \t\r\x0b\x0c"), ("line", "\n")):
    for _c in _chars:
        _kind[ord(_c)] = KINDS.index(_name)
_kind[ord("A") : ord("Z") + 1] = KINDS.index("upper")
_kind[ord("a") : ord("z") + 1] = KINDS.index("lower")
_kind[ord("0") : ord("9") + 1] = KINDS.index("digit")
_kind[128:] = KINDS.index("high")


def measures(texts: list[str]) -> np.ndarray:
    """One row of style measures per text."""
    n = len(texts)
    buf, starts = lay_out(texts)
    row = np.repeat(np.arange(n), np.diff(starts))
    kinds = np.bincount(row * len(KINDS) + _kind[buf], minlength=n * len(KINDS)).reshape(n, -1).astype(float)
    kinds[:, KINDS.index("line")] -= 1  # the separator
    chars = np.maximum(kinds.sum(axis=1), 1)
    first, past = spans(~is_blank(buf))
    hashes = Hasher(buf)(first, past)
    of = np.searchsorted(starts, first, side="right") - 1
    n_words = np.bincount(of, minlength=n)
    some = np.maximum(n_words, 1)

    def distinct(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        key = h ^ mix(rows.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, bool)
        return np.bincount(rows[order[new]], minlength=n)

    again = np.zeros(len(of), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    three = shingles(hashes, 3)
    inside = of[2:] == of[: len(three)] if len(three) else np.zeros(0, bool)
    three, three_of = three[inside], of[: len(inside)][inside]
    n_three = np.maximum(np.bincount(three_of, minlength=n), 1)
    length = (past - first).astype(float)
    last = buf[past - 1] if len(past) else np.zeros(0, np.uint8)
    ends = np.isin(_kind[last], [KINDS.index(k) for k in ("symbol", "shout", "pipe")]) if len(last) else np.zeros(0, bool)
    mean = np.bincount(of, weights=length, minlength=n) / some
    rates = kinds / chars[:, None]
    extra = np.stack((
        np.log1p(n_words), mean, np.bincount(of, weights=again, minlength=n) / some, distinct(hashes, of) / some ** 0.8, 1 - distinct(three, three_of) / n_three,
        np.bincount(of, weights=ends, minlength=n) / some, rates[:, KINDS.index("upper")] / np.maximum(rates[:, KINDS.index("upper")] + rates[:, KINDS.index("lower")], 1e-9), kinds[:, KINDS.index("line")] / some,
    ), axis=1)
    return np.concatenate((rates, extra), axis=1)


@dataclass
class Model:
    edges: np.ndarray  # (measures, bins - 1)
    weights: np.ndarray
    bias: float = 0.0
    at: float = 0.0
    scale: float = 1.0

    def sets(self, m: np.ndarray) -> pu.Sets:
        wide = self.edges.shape[1] + 1
        bins = np.stack([np.searchsorted(e, m[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)
        return pu.Sets(np.arange(len(m) + 1) * len(self.edges), (bins + np.arange(len(self.edges)) * wide).ravel())

    def margins(self, m: np.ndarray) -> np.ndarray:
        return pu.margins(self.sets(m), self.weights, self.bias)


def _all(texts: list[str]) -> np.ndarray:
    parts = [measures(part) for _, part in bundles(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(KINDS) + 8))


def _edges(u: np.ndarray) -> np.ndarray:
    """Bin edges of each measure: half at quantiles of all values, half at quantiles of those above the smallest."""
    out = []
    for v in u.T:
        above = v[v > v.min()] if (v > v.min()).any() else v
        out.append(np.sort(np.concatenate((np.quantile(v, np.linspace(0, 1, BINS // 2 + 2)[1:-1]), np.quantile(above, np.linspace(0, 1, BINS // 2)[:-1])))))
    return np.array(out)


def train(positive: list[str], unlabelled: list[str], poor: list[str], prior: float) -> Model:
    p, u, n = _all(positive), _all(unlabelled), _all(poor)
    if not len(p) or not len(u):
        return Model(np.zeros((len(KINDS) + 8, BINS - 1)), np.zeros((len(KINDS) + 8) * BINS))
    model = Model(_edges(u), np.zeros(u.shape[1] * BINS))
    fit_on = np.arange(len(p)) % 5 != 0
    model.weights, model.bias = pu.fit(model.sets(p[fit_on]), model.sets(u), prior, len(model.weights))
    z = np.concatenate((model.margins(p[~fit_on]), model.margins(n)))
    model.at, model.scale = pu.cut(z, np.concatenate((np.ones((~fit_on).sum()), np.zeros(len(n)))).astype(int))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = FOLDS, held: int = HELD, decision: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per input row.

    Labels of the held-out fold, ids, languages and sources never reach the model. Null and empty
    texts are scored as texts without words. Without trusted positives every score is the same. Repeated
    rows get equal scores; a repeated id is learned from once, by one of its texts.
    """
    known = clean_labels(labels, column).where(fold(F.col("doc_id"), folds) != held)
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_poor = sizes.get(1, 0), sizes.get(0, 0)
    prior = min(max(n_pos / max(n_pos + n_poor, 1), 0.001), 0.999)
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    kinds = (("p", known.where("y = 1").select("doc_id"), n_pos, POSITIVES), ("n", known.where("y = 0").select("doc_id"), n_poor, POOR), ("u", learn, distinct_ids(learn), UNLABELLED))
    picked = None
    for i, (kind, rows, n, limit) in enumerate(kinds):
        part = pick(rows, n, limit, seed=10 + i).withColumn("kind", F.lit(kind))
        picked = part if picked is None else picked.unionByName(part)
    by = gather(docs, picked, {"p": POSITIVES, "n": POOR, "u": UNLABELLED})
    model = train(by["p"], by["u"], by["n"], prior)

    def run(ids: list, texts: list) -> dict:
        s = pu.score(model.margins(measures([t or "" for t in texts])), model.at, model.scale, decision)
        return {"doc_id": ids, "score": s, "predicted": (s >= decision).astype(np.int32)}

    scored = map_texts(text_rows(docs), run, "doc_id long, score double, predicted int")
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")
