"""Quality rules by repetition coverage.

Words get ids, and rolling hashes of several n-gram lengths show which word windows occur more
than once in a text. A window of n+1 words can only repeat where its first n words repeat, so
each length looks only at the places the shorter one left. The measure is the share of word
characters that lie inside repeated windows (each character once), inside the most frequent
short n-gram, or inside repeated lines.

One map over the documents: no shuffle, one bounded run of texts in memory at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.rows import bundles, map_texts, text_rows
from gridloom.llm.textkit import BASE, mix

# Largest share of word characters inside repeated windows, by words in a window.
COVER_LIMITS = {5: 0.40, 6: 0.39, 7: 0.38, 8: 0.37, 9: 0.36, 10: 0.35}
# Largest share of word characters inside the most frequent n-gram.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
LINE_COUNT_LIMIT, LINE_CHAR_LIMIT = 0.50, 0.30
BASE_NGRAM, BASE_WORDS, BASE_PERCENT = 8, 20, 30

SYMBOLS = re.compile(r"[#*$%&|<>]")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, dup_char_share double, top_gram_share double"


class _Ids(dict):
    """Ids of words in order of appearance, with their lengths in code points."""

    def __init__(self) -> None:
        super().__init__()
        self.chars: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self.chars.append(len(word.decode("utf-8", "replace")))
        n = self[word] = len(self)
        return n


def _lines(text: str) -> tuple[int, int, int, int]:
    """Lines with a word, those equal to an earlier one, and the characters of both."""
    seen: set[str] = set()
    n = dup = chars = dup_chars = 0
    for line in text.split("\n"):
        if not line.strip(" \t\n\r\x0b\x0c"):
            continue
        n += 1
        chars += len(line)
        if line in seen:
            dup += 1
            dup_chars += len(line)
        else:
            seen.add(line)
    return n, dup, chars, dup_chars


def _repeats(ids: np.ndarray, chars: np.ndarray, first: np.ndarray, lengths: list[int], tops: list[int]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Per length: which words lie in repeated windows; and per text the characters of its top n-gram."""
    n_docs, n = len(first) - 1, len(ids)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    last = first[1:][doc]
    one = mix(ids.astype(np.uint64) + np.uint64(1))
    upto = np.concatenate(([0], np.cumsum(chars)))
    rolled = one ^ mix(doc.astype(np.uint64) + np.uint64(1 << 40))
    at = np.arange(n)
    covered, top = {}, {}
    for size in range(2, max(lengths + tops) + 1):
        keep = at + size <= last[at]
        at, rolled = at[keep], rolled[keep]
        rolled = rolled * np.uint64(BASE) + one[at + size - 1]
        key = mix(rolled)
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        count = np.bincount(run) if len(run) else np.zeros(0, np.int64)
        if size in tops:
            best = np.zeros(n_docs)
            lead = at[order[new]]
            share = np.where(count > 1, count * (upto[lead + size] - upto[lead]), 0) if len(lead) else np.zeros(0)
            np.maximum.at(best, doc[lead], share)
            top[size] = best
        again = np.sort(order[count[run] > 1]) if len(run) else order
        at, rolled = at[again], rolled[again]
        if size in lengths:
            step = np.zeros(n + 1, np.int64)
            step[at] += 1
            step[at + size] -= 1
            covered[size] = np.cumsum(step[:n]) > 0
    return covered, top


def measure(ids: list, texts: list[str | None]) -> dict:
    """All measures and verdicts of a run of texts."""
    texts = [t or "" for t in texts]
    vocab = _Ids()
    split = [t.encode("utf-8", "replace").split() for t in texts]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(w) for w in split], out=first[1:])
    flat = np.fromiter(map(vocab.__getitem__, chain.from_iterable(split)), np.int64, first[-1])
    chars = np.asarray(vocab.chars, np.int64)[flat] if len(flat) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    covered, top = _repeats(flat, chars, first, sorted({*COVER_LIMITS, BASE_NGRAM}), sorted(TOP_LIMITS))

    def per_doc(v: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=v, minlength=len(texts)) if len(doc) else np.zeros(len(texts))

    n_words = np.diff(first)
    word_chars = per_doc(chars).astype(np.int64)
    base_words = per_doc(covered[BASE_NGRAM]).astype(np.int64)
    lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 4)
    whole = np.maximum(word_chars, 1)
    line_share = lines[:, 1] / np.maximum(lines[:, 0], 1)
    line_chars = lines[:, 3] / np.maximum(lines[:, 2], 1)
    covers = {k: per_doc(chars * covered[k]) / whole for k in COVER_LIMITS}
    tops = {k: np.minimum(top[k] / whole, 1.0) for k in TOP_LIMITS}
    failed = (n_words < BASE_WORDS) | (100 * base_words > BASE_PERCENT * n_words)
    bad = (line_share > LINE_COUNT_LIMIT) | (line_chars > LINE_CHAR_LIMIT)
    for k, limit in COVER_LIMITS.items():
        bad |= covers[k] > limit
    for k, limit in TOP_LIMITS.items():
        bad |= tops[k] > limit
    return {
        "doc_id": ids, "n_words": n_words, "word_chars": word_chars, "n_symbols": [len(SYMBOLS.findall(t)) for t in texts], "n_dup_lines": lines[:, 1], "n_repeat_words": base_words,
        "base_failed": failed, "kept": ~failed & ~bad, "dup_line_share": line_chars, "dup_char_share": covers[min(COVER_LIMITS)], "top_gram_share": np.max([tops[k] for k in TOP_LIMITS], axis=0),
    }


def score_documents(docs: DataFrame) -> DataFrame:
    """Measures and verdict, one row per input row.

    Null and empty texts have no words and fail the base rule. Repeated rows and ids are judged
    row by row. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    return map_texts(text_rows(docs), measure, SCHEMA)


CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns: one map, no shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            kept = [measure(list(range(len(part))), part)["kept"] for _, part in bundles(texts)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
