"""Toxicity scores by non-negative positive-unlabelled learning.

Features are the distinct words of a text and the beginnings of words (4 to 6 bytes), as 64-bit
hashes. Those that confirmed toxic texts hold clearly more often than unlabelled texts get a weight
by the risk estimator in ``pu``; all others have none, so long clean texts gather no noise. The
class prior is the share of toxic rows among all labelled rows of the learning folds. Rows known
to be clean serve only to place the decision.

Bounds: at most ``POSITIVES`` toxic, ``UNLABELLED`` unlabelled and ``CLEAN`` clean rows are learned
from, and at most ``FEATURES`` features kept; every row is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import pu
from gridloom.llm.rows import bundles, map_texts, text_rows
from gridloom.llm.samples import clean_labels, distinct_ids, fold, gather, pick
from gridloom.llm.textkit import Hasher, lay_out, mix, spans

POSITIVES, UNLABELLED, CLEAN, FEATURES = 3000, 6000, 3000, 20_000
FOLDS, HELD = 3, 1
PREFIXES = (4, 5, 6)
LEAST_ROWS, LEAST_RATIO, LEAST_SIGMA = 3, 2.5, 4.0
SLOTS = 1 << 20

_letter = np.zeros(256, bool)
_letter[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all words and word beginnings, and the row of each (with repeats)."""
    buf, starts = lay_out([t.lower() for t in texts])
    first, past = spans(_letter[buf])
    hasher = Hasher(buf)
    row = np.searchsorted(starts, first, side="right") - 1
    found, rows = [hasher(first, past)], [row]
    for k in PREFIXES:
        long = past - first >= k
        found.append(mix(hasher(first[long], first[long] + k) + np.uint64(k)))
        rows.append(row[long])
    return np.concatenate(found), np.concatenate(rows)


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float
    at: float
    scale: float
    slots: np.ndarray  # which low bits occur among the keys

    def sets(self, texts: list[str]) -> pu.Sets:
        """Known features of each text, a bounded run of texts at a time."""
        parts = [self._sets(part) for _, part in bundles(texts)]
        sizes = np.concatenate([np.diff(p.starts) for p in parts]) if parts else np.zeros(0, np.int64)
        return pu.Sets(np.concatenate(([0], np.cumsum(sizes))), np.concatenate([p.features for p in parts]) if parts else np.zeros(0, np.int64))

    def _sets(self, texts: list[str]) -> pu.Sets:
        found, rows = features(texts)
        near = self.slots[(found & np.uint64(SLOTS - 1)).astype(np.int64)]
        found, rows = found[near], rows[near]
        place = np.minimum(np.searchsorted(self.keys, found), max(len(self.keys) - 1, 0))
        hit = self.keys[place] == found if len(self.keys) else np.zeros(0, bool)
        both = np.unique(rows[hit] * np.int64(max(len(self.keys), 1)) + place[hit])
        row, feature = np.divmod(both, max(len(self.keys), 1))
        return pu.Sets(np.searchsorted(row, np.arange(len(texts) + 1)), feature)

    def margins(self, texts: list[str]) -> np.ndarray:
        return pu.margins(self.sets(texts), self.weights, self.bias)


def _distinct(texts: list[str]) -> Iterator[np.ndarray]:
    """Features of a few texts at a time, each once per text."""
    for _, part in bundles(texts):
        found, rows = features(part)
        order = np.lexsort((rows, found))
        found, rows = found[order], rows[order]
        if len(found):
            yield found[np.concatenate(([True], (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])))]


def _common(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Features that at least ``least`` texts hold, and how many do.

    A first pass counts hash slots only, so rare features, which are most, are never gathered.
    """
    slots = np.zeros(1 << 22, np.int32)
    low = np.uint64(len(slots) - 1)
    for found in _distinct(texts):
        slots += np.bincount((found & low).astype(np.int64), minlength=len(slots)).astype(np.int32)
    held = [found[slots[(found & low).astype(np.int64)] >= least] for found in _distinct(texts)]
    keys, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return keys[counts >= least], counts[counts >= least]


def _counts(texts: list[str], keys: np.ndarray) -> np.ndarray:
    """In how many texts each of the sorted ``keys`` occurs."""
    seen = np.zeros(len(keys), np.int64)
    for found in _distinct(texts) if len(keys) else ():
        place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        seen += np.bincount(place[keys[place] == found], minlength=len(keys))
    return seen


def train(positive: list[str], unlabelled: list[str], clean: list[str], prior: float) -> Model:
    keys, n_pos = _common(positive, min(LEAST_ROWS, max(1, len(positive) // 10)))
    seen = _counts(unlabelled, keys)
    ratio = ((n_pos + 0.5) / max(len(positive), 1)) / ((seen + 0.5) / max(len(unlabelled), 1))
    expected = (seen + 0.5) * max(len(positive), 1) / max(len(unlabelled), 1)
    ratio[(ratio < LEAST_RATIO) | (n_pos - expected < LEAST_SIGMA * np.sqrt(expected))] = 0
    best = np.argsort(-ratio * np.sqrt(n_pos), kind="stable")[:FEATURES]
    keys = np.sort(keys[best[ratio[best] > 0]])
    slots = np.zeros(SLOTS, bool)
    slots[(keys & np.uint64(SLOTS - 1)).astype(np.int64)] = True
    model = Model(keys, np.zeros(len(keys)), 0.0, 0.0, 1.0, slots)
    if not positive or not unlabelled or not len(keys):
        return model
    fit_on = np.arange(len(positive)) % 5 != 0
    pos = model.sets(positive)
    model.weights, model.bias = pu.fit(pos.take(np.flatnonzero(fit_on)), model.sets(unlabelled), prior, len(keys))
    held = pos.take(np.flatnonzero(~fit_on))
    z = np.concatenate((pu.margins(held, model.weights, model.bias), model.margins(clean)))
    model.at, model.scale = pu.cut(z, np.concatenate((np.ones(held.n), np.zeros(len(clean)))).astype(int))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = FOLDS, held: int = HELD, decision: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per input row.

    Labels of the held-out fold, ids, languages and sources never reach the model. Null and empty
    texts get the score of a text without any known feature. Without toxic labels every score is
    the same. Repeated rows get equal scores; a repeated id is learned from once, by one of its texts.
    """
    known = clean_labels(labels, column).where(fold(F.col("doc_id"), folds) != held)
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    prior = min(max(n_pos / max(n_pos + n_clean, 1), 0.001), 0.999)
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    kinds = (("p", known.where("y = 1").select("doc_id"), n_pos, POSITIVES), ("n", known.where("y = 0").select("doc_id"), n_clean, CLEAN), ("u", learn, distinct_ids(learn), UNLABELLED))
    picked = None
    for i, (kind, rows, n, limit) in enumerate(kinds):
        part = pick(rows, n, limit, seed=i).withColumn("kind", F.lit(kind))
        picked = part if picked is None else picked.unionByName(part)
    by = gather(docs, picked, {"p": POSITIVES, "n": CLEAN, "u": UNLABELLED})
    model = train(by["p"], by["u"], by["n"], prior)

    def run(ids: list, texts: list) -> dict:
        s = pu.score(model.margins([t or "" for t in texts]), model.at, model.scale, decision)
        return {"doc_id": ids, "score": s, "predicted": (s >= decision).astype(np.int32)}

    scored = map_texts(text_rows(docs), run, "doc_id long, score double, predicted int")
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")
