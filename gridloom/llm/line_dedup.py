"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

State, as two written tables:

* ``counts``: one row per line key (128-bit digest of the stripped, lower-cased line) with the
  number of documents that hold it, and its shard;
* ``filters``: one cuckoo filter per shard, holding the keys found in at least ``min_docs`` documents.

``update`` adds or takes away documents: counts change by a grouped sum, and only keys that cross
the threshold are inserted into or deleted from their shard's filter, so any document can be taken
back. ``drop_lines`` asks the filters first: lines that miss are kept without touching the exact
table; the few that hit are confirmed by a join with the exact counts.

A line that very many documents hold is one row in ``counts`` (summed before the shuffle). For
lookups its occurrences are dealt over as many salts as its shard's load asks for, and the small
filter is repeated per salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import cuckoo
from gridloom.llm.rows import map_texts, partitions, row_key, settle, text_rows, unless_large

BLANK = b" \t\n\r\x0b\x0c"
KEYS_PER_SHARD = 200_000
MIN_DOCS = 10
COUNT_SCHEMA = "hi long, lo long, shard int, n_docs long"
FILTER_SCHEMA = "shard int, n_keys long, data binary"


@dataclass(frozen=True)
class LineState:
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(BLANK).lower()


def _digest_rows(ids: list, texts: list) -> dict:
    owner, digests, places = [], [], []
    for i, text in enumerate(texts):
        held: dict[bytes, list[int]] = {}
        for at, line in enumerate((text or "").encode("utf-8", "replace").split(b"\n")):
            key = line_key(line)
            if key:
                held.setdefault(key, []).append(at)
        for key, at in held.items():
            owner.append(i)
            digests.append(hashlib.md5(key, usedforsecurity=False).digest())
            places.append(at)
    both = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
    return {"row": [ids[i] for i in owner], "hi": both[:, 0], "lo": both[:, 1], "at": places}


def line_keys(docs: DataFrame) -> DataFrame:
    """Distinct line keys of each row with the places of their lines: ``_id, _tx, hi, lo, at``."""
    rows = text_rows(docs).select(F.struct(*row_key()).alias("doc_id"), "text")
    found = map_texts(rows, _digest_rows, "row struct<_id: long, _tx: long>, hi long, lo long, at array<int>")
    return found.select("row._id", "row._tx", "hi", "lo", "at")


def _update_shard(key: tuple, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    """New filter of one shard. ``keys``: all its keys at or over the threshold now, or just below it."""
    now, was = keys["now"].to_numpy(bool), keys["was"].to_numpy(bool)
    hi, lo = (np.ascontiguousarray(keys[c].to_numpy(np.int64)) for c in ("hi", "lo"))
    filt = cuckoo.Cuckoo.from_bytes(bytes(old["data"].iloc[0])) if len(old) else cuckoo.Cuckoo(int(now.sum()))
    try:
        filt.delete(hi[was & ~now], lo[was & ~now])
        filt.insert(hi[now & ~was], lo[now & ~was])
    except cuckoo.Full:
        filt = cuckoo.build(hi[now], lo[now])
    return pd.DataFrame({"shard": [key[0]], "n_keys": [int(now.sum())], "data": [filt.to_bytes()]})


def update(state: LineState | None, docs: DataFrame, sign: int = 1, min_docs: int = MIN_DOCS, found: DataFrame | None = None) -> LineState:
    """Insert (``sign=1``) or delete (``sign=-1``) whole documents; a new state comes back.

    Counts never fall below zero: taking away a document that was never added changes nothing for
    lines nobody holds. An empty table leaves the state as it is.
    """
    spark = docs.sparkSession
    found = line_keys(docs) if found is None else found
    delta = found.groupBy("hi", "lo").agg((F.count(F.lit(1)) * sign).alias("d"))
    if state is None:
        delta = settle(delta, "line-counts")
        shards = max(2 * partitions(spark), -(-delta.count() // KEYS_PER_SHARD))
        merged = delta.select("hi", "lo", F.lit(0).cast("long").alias("old"), F.greatest("d", F.lit(0)).alias("n_docs"))
        filters = spark.createDataFrame([], FILTER_SCHEMA)
    else:
        shards, min_docs, filters = state.shards, state.min_docs, state.filters
        old = F.coalesce(F.col("n_docs"), F.lit(0))
        merged = state.counts.drop("shard").join(delta, ["hi", "lo"], "full").select("hi", "lo", old.alias("old"), F.greatest(old + F.coalesce("d", F.lit(0)), F.lit(0)).alias("n_docs"))
    shard = F.pmod(F.xxhash64("hi", "lo"), F.lit(shards)).cast("int")
    merged = settle(merged.withColumn("shard", shard), "line-merge")
    near = merged.where((F.col("old") >= min_docs) | (F.col("n_docs") >= min_docs)).select("shard", "hi", "lo", (F.col("old") >= min_docs).alias("was"), (F.col("n_docs") >= min_docs).alias("now"))
    made = filters.groupBy("shard").cogroup(near.groupBy("shard")).applyInPandas(_update_shard, FILTER_SCHEMA)
    counts = merged.where("n_docs > 0").select("hi", "lo", "shard", "n_docs")
    return LineState(counts, settle(made, "line-filters"), shards, min_docs)


_HIT_SCHEMA = "_id long, _tx long, hi long, lo long, at array<int>"
_HIT_ARROW = pa.schema([("_id", pa.int64()), ("_tx", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("at", pa.list_(pa.int32()))])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, salt), each group's filter first: pass on the lines the filter may hold."""
    filt, place = None, None
    for batch in batches:
        shard, salt, data = (batch.column(i) for i in range(3))
        groups = np.stack((shard.to_numpy(), salt.to_numpy()))
        cuts = np.concatenate(([0], np.flatnonzero((groups[:, 1:] != groups[:, :-1]).any(axis=0)) + 1, [batch.num_rows])) if batch.num_rows else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = tuple(groups[:, a])
            if here != place:
                filt, place = None, here
            if data[a].is_valid:
                filt = cuckoo.Cuckoo.from_bytes(data[a].as_py())
                a += 1
            if filt is None or a == b:
                continue
            part = pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(3, 8)], schema=_HIT_ARROW)
            hit = filt.contains(part.column(2).to_numpy(), part.column(3).to_numpy())
            if hit.any():
                yield part.filter(pa.array(hit))


def frequent_lines(found: DataFrame, state: LineState) -> DataFrame:
    """Rows of ``found`` whose key at least ``min_docs`` documents hold."""
    spark = found.sparkSession
    shard = F.pmod(F.xxhash64("hi", "lo"), F.lit(state.shards)).cast("int")
    load = state.counts.groupBy("shard").agg(F.sum("n_docs").alias("load"))
    total = load.agg(F.sum("load")).first()[0] or 0
    each = max(1000, total // (4 * partitions(spark)))
    # One row per shard; a shard has many keys, so this stays far smaller than the lines.
    salts = settle(load.select("shard", F.ceil(F.col("load") / each).cast("int").alias("salts")), "line-salts")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("_id", "long"), ("_tx", "long"), ("hi", "long"), ("lo", "long"), ("at", "array<int>"))]
    lines = found.withColumn("shard", shard).join(salts, "shard").select("shard", F.pmod(F.xxhash64("_id", "_tx"), F.col("salts")).cast("int").alias("salt"), F.lit(None).cast("binary").alias("data"), "_id", "_tx", "hi", "lo", "at")
    copies = state.filters.where("n_keys > 0").join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "data", *none)
    dealt = copies.unionByName(lines).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("data").isNull())
    maybe = dealt.mapInArrow(_probe, _HIT_SCHEMA)
    exact = state.counts.where(F.col("n_docs") >= state.min_docs).select("hi", "lo")
    return maybe.join(exact, ["hi", "lo"])


def drop_lines(docs: DataFrame, state: LineState, found: DataFrame | None = None) -> DataFrame:
    """``_row`` (the whole input row), ``n_lines``, ``n_dropped`` and the ``kept`` text, one row per input row.

    Null and empty texts have one empty line, which stays. A key without a character is never
    dropped. Equal rows lose equal lines. Any other columns ride along inside ``_row``.
    """
    found = line_keys(docs) if found is None else found
    once = frequent_lines(found, state).dropDuplicates(["_id", "_tx", "hi", "lo"])  # equal rows have equal lines
    drops = once.groupBy("_id", "_tx").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))  # at most the lines of one text
    packed = docs.select(F.struct("*").alias("_row"), *row_key()).join(drops, ["_id", "_tx"], "left")
    at = F.coalesce("at", F.array().cast("array<int>"))
    lines = F.split(F.coalesce(F.col("_row.text"), F.lit("")), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), at)
    kept = F.when(F.size(at) == 0, F.coalesce(F.col("_row.text"), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return packed.select("_row", F.size(lines).cast("long").alias("n_lines"), F.size(at).cast("long").alias("n_dropped"), kept.alias("kept"))


def once_per_id(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``hi, lo`` of ``found``, once for each id; each row without an id is a document of its own.

    Only the lines of ids that stand in several rows are dealt out, by line and id; the others are passed on.
    """
    again = settle(text_rows(docs).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("_id"), "repeated-ids")
    ids = unless_large(again)
    several = found.join(ids, "_id", "left_semi").select("hi", "lo", "_id").distinct()
    return found.join(ids, "_id", "left_anti").select("hi", "lo").unionByName(several.select("hi", "lo"))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, by_id: bool = False) -> tuple[DataFrame, LineState]:
    """Count the lines of ``docs`` and drop the frequent ones. A document is a row, or with ``by_id`` all rows of one id."""
    found = settle(line_keys(docs), "lines")
    state = update(None, docs, 1, min_docs, once_per_id(found, docs) if by_id else found)
    return drop_lines(docs, state, found), state
