"""Byte-level BPE by tree reduction: encode halves, join neighbours, decode up the tree.

A text is a product of its parts, and encodings form a monoid under ``join``:

- Inside one match of the split pattern the bytes are halved down to leaves of eight. ``join`` of
  two encoded halves re-encodes a window around the seam, one token on each side at first, and
  widens it on a side whose edge is not yet proved.
- Between two matches of the pattern the seam is fixed, so ``join`` is plain concatenation.

Why an edge is proved: call two adjacent tokens stable if merging their joined bytes gives these
two tokens again. Greedy merging (lowest rank first, leftmost on ties), seen only on the bytes of
two neighbouring tokens, takes the same steps as greedy merging of these bytes alone, up to the
first merge across their border. So a sequence of tokens, each the encoding of its own bytes, is
the encoding of the whole exactly if all its neighbours are stable. Both halves are encodings, so
only the two edges of the window have to be tested; everything outside stands.

Texts are cut for the upper tree where a sign that is not white space meets a space that a sign
follows: no match of the pattern spans that place and no lookahead sees past it.

Rows are independent: null text counts as empty and gives no ids, equal rows give equal rows,
null and repeated ``doc_id`` stay as they are, other columns are not read, an empty table gives an
empty one. Memory of a task: one run of texts (``rows.CHUNK_CHARS`` characters, or one longer
text), its ids, and caches of bounded size.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.rows import map_texts, text_rows
from gridloom.llm.tokens import public_path

CACHE_PIECES = 400_000
CACHE_JOINS = 200_000
CACHE_CHARS = 64
BLOCK_CHARS = 1 << 16
DECODE_LEAF = 4096
LEAF_BYTES = 8
SHORT_BYTES = 96
_NEVER = 1 << 32

# Letters, digits and white space among the first 256 signs, by Unicode's general categories and White_Space.
_LATIN = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼-¾", r"\s": "\t\n\x0b\x0c\r \x85\xa0"}
_ANY = {r"\p{L}": r"\p{L}", r"\p{N}": r"\p{N}", r"\s": r"\p{White_Space}"}
_SEAM = re.compile(r"(?<=\S) (?=\S)")


def split_pattern(classes: dict[str, str]) -> str:
    """The public split pattern of the rank files, over the given contents of its character classes."""
    letter, digit, space = classes[r"\p{L}"], classes[r"\p{N}"], classes[r"\s"]
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+"


class _Cache(dict):
    """Values by key, made on demand; emptied when full, and long keys are never kept."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


class RankBpe:
    """Encoder and decoder of one rank file (base64 token, rank; one a line)."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        self.latin, self.any = re.compile(split_pattern(_LATIN)), regex.compile(split_pattern(_ANY))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.short = _Cache(self._merge_short, CACHE_JOINS)  # leaves and windows recur from word to word
        self.pieces = _Cache(self._piece, CACHE_PIECES)

    # --- bytes of one match -------------------------------------------------------------

    def merge(self, data: bytes) -> list[bytes]:
        """Greedy merging of ``data``: the lowest rank first, leftmost on ties; n log n by a heap of candidate pairs."""
        n = len(data)
        if n <= SHORT_BYTES:
            return self.short[data]
        nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        ranks = self.ranks
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue  # one of the two parts has changed since
            end[i], nxt[i], alive[j] = stop, nxt[j], False
            if nxt[j] < n:
                prev[nxt[j]] = i
                if (r := ranks.get(data[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if prev[i] >= 0 and (r := ranks.get(data[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        out, i = [], 0
        while i < n:
            out.append(data[i : end[i]])
            i = nxt[i]
        return out

    def _merge_short(self, data: bytes) -> list[bytes]:
        """The same for few bytes: a pair's rank stands beside its left part, the least one is searched anew each time."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        costs = [get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) < _NEVER:
            i = costs.index(least)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], _NEVER)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], _NEVER)
        return parts

    def stable(self, left: bytes, right: bytes) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_JOINS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    def join(self, a: list[bytes], b: list[bytes]) -> list[bytes]:
        """Encoding of the bytes of ``a`` followed by those of ``b``, both being encodings."""
        if not a or not b or self.stable(a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            window = self.merge(b"".join(a[len(a) - i :]) + b"".join(b[:j]))
            left = i == len(a) or self.stable(a[-i - 1], window[0])
            right = j == len(b) or self.stable(window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            i, j = i if left else min(2 * i, len(a)), j if right else min(2 * j, len(b))

    def tree(self, data: bytes) -> list[bytes]:
        """Tokens of ``data``: halves first, then their join."""
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        if data in self.packed:  # a match that is a token as it stands is never merged
            return self.packed[data]
        return b"".join(map(self.packed.__getitem__, self.tree(data)))

    # --- whole texts --------------------------------------------------------------------

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        if len(text) > BLOCK_CHARS:
            seam = _SEAM.search(text, len(text) // 2) or _SEAM.search(text)
            if seam:
                return self.encode(text[: seam.start()]) + self.encode(text[seam.start() :])
        try:
            text.encode("latin-1")
            found = self.latin.findall(text)
        except UnicodeEncodeError:
            found = self.any.findall(text)
        return b"".join(map(self.pieces.__getitem__, found))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of packed ids, concatenated up the tree."""
        if len(ids) > 4 * DECODE_LEAF:
            half = len(ids) // 8 * 4
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[str, RankBpe] = {}


def coder(path: str) -> RankBpe:
    """One coder per worker process and rank file."""
    if path not in _coders:
        _coders[path] = RankBpe(path)
    return _coders[path]


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, n_tokens, ids``: ids as little-endian unsigned 32-bit integers, one row per row of ``docs``."""

    def run(keys: list, texts: list) -> dict:
        ids = [coder(ranks).encode(t or "") for t in texts]
        return {"doc_id": keys, "n_tokens": [len(i) // 4 for i in ids], "ids": ids}

    return map_texts(text_rows(docs), run, "doc_id long, n_tokens long, ids binary")


def decode(coded: DataFrame, ranks: str) -> DataFrame:
    """``doc_id, n_tokens, ids, content`` of encoded rows; null ids count as none."""
    schema = "doc_id long, n_tokens long, ids binary, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                content = pa.array([coder(ranks).decode(i or b"") for i in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, content], names=["doc_id", "n_tokens", "ids", "content"])

    return coded.select("doc_id", "n_tokens", "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Digests of what ``encode`` and then ``decode`` give for each row."""
    path = ranks or public_path("byte_bpe_multi_50k.tiktoken")
    back = decode(encode(docs, path), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("content", 256).alias("decoded_sha256"))
