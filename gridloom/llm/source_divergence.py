"""Source divergence audit: how far the word use of each source lies from the other sources of its language.

Counting is an Arrow compute pipeline inside ``mapInArrow``: ``ascii_lower``, ``split_pattern_regex``,
``dictionary_encode`` and hash ``group_by`` turn bounded slices of texts into partial counts, which
a task merges while it reads and hands on pre-aggregated. Merged counts are dealt into columnar
shards by (language, hash of term); a shard holds all sources of its terms, so the language's own
counts are column sums, and each shard gives its part of every divergence and its best terms.

Defined results: null text, lang and source count as ''; each row is a document of its own, whatever
its ``doc_id`` (repeated rows count each time); a group without terms keeps its row among the
groups; a language without kept terms has V = 0 and divergences of 0; ties of a value go by the
item's UTF-8 bytes; other columns are not read; an empty table gives an empty result. All
arithmetic is on integers and exact up to 9 * 10^15 words a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.rows import settle, text_slices, unless_large

# What separates terms, and the scale and smoothing of the shares.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, SMOOTH = 1_000_000_000, 5

SLICE_BYTES = 1 << 22
HELD_ROWS = 1 << 20
SHARD_ROWS = 1 << 18
CELLS = 1 << 22

COUNTS = "lang string, source string, term string, n long, docs long"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_FOUND = "lang string, source string, part string, item string, value long"
_FOUND_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def count_slice(batch: pa.RecordBatch) -> pa.Table:
    """Partial counts of one slice (``lang, source, text``): occurrences and rows by term; the term '' carries the rows of a group."""
    lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
    width = max(len(source.dictionary), 1)
    group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), pattern=SEPARATORS)
    row, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    words = flat.filter(real).dictionary_encode()
    by_row = pa.table({"row": row.filter(real), "term": words.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    rows = by_row.column("row").to_numpy()
    cells = pa.table({"group": group[rows], "term": by_row.column("term"), "n": by_row.column("count_all")}).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    known, sizes = np.unique(group, return_counts=True)
    code = np.concatenate((cells.column("group").to_numpy(), known))
    terms = pa.concat_arrays([words.dictionary.take(cells.column("term").combine_chunks()), pa.array([""] * len(known), pa.string())])
    n = np.concatenate((cells.column("n_sum").to_numpy(), np.zeros(len(known), np.int64)))
    docs = np.concatenate((cells.column("n_count").to_numpy(), sizes))
    return pa.table([lang.dictionary.take(pa.array(code // width)), source.dictionary.take(pa.array(code % width)), terms, pa.array(n), pa.array(docs)], schema=_COUNTS_ARROW)


def _merge(held: list[pa.Table]) -> pa.Table:
    if len(held) == 1:
        return held[0]
    grouped = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return grouped.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS_ARROW.names)


def partial_counts(docs: DataFrame) -> DataFrame:
    """Pre-aggregated ``lang, source, term, n, docs`` of each task; sums over tasks are the counts.

    A task merges its slices when they pass ``HELD_ROWS`` and hands them on where merging no longer halves them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            for part in text_slices(batch, 2, SLICE_BYTES):
                held.append(count_slice(part))
                size += held[-1].num_rows
                if size > HELD_ROWS:
                    held = [_merge(held)]
                    size = held[0].num_rows
                    if size > HELD_ROWS // 2:
                        yield from held[0].combine_chunks().to_batches(max_chunksize=1 << 16)
                        held, size = [], 0
        if held:
            yield from _merge(held).combine_chunks().to_batches(max_chunksize=1 << 16)

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(run, COUNTS)


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """``1 + floor(SCALE * count / total)``, digit by digit so that no product leaves 64 bits."""
    rest, out = count.astype(np.int64), np.zeros(count.shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _shard(best: int):
    """Divergence parts and the ``best`` terms of each source, for one shard of one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        is_group = pc.equal(table.column("term"), "")
        groups, cells = table.filter(is_group), table.filter(pc.invert(is_group))
        if not cells.num_rows:
            return
        order = pc.sort_indices(groups.column("source"))
        groups = groups.take(order)
        lang, sources = groups.column("lang")[0].as_py(), groups.column("source").combine_chunks()
        kept, in_lang = groups.column("kept")[0].as_py(), groups.column("in_lang")[0].as_py()
        sums = groups.column("n").to_pylist()
        words = cells.column("term").combine_chunks().dictionary_encode()
        word, n = words.indices.to_numpy(), cells.column("n").to_numpy()
        src = pc.index_in(cells.column("source").combine_chunks(), value_set=sources).to_numpy(zero_copy_only=False).astype(np.int64)
        totals = np.array(sums, np.int64) + SMOOTH * kept

        # Best terms: only cells with a count can win; the language's count is the sum of the column.
        column = np.zeros(len(words.dictionary), np.int64)
        np.add.at(column, word, n)
        q = shares(column + SMOOTH, in_lang + SMOOTH * kept)[word]
        p = shares(n + SMOOTH, totals[src])
        place = np.empty(len(words.dictionary), np.int64)
        place[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(place))
        up = np.flatnonzero(p > q)
        up = up[np.lexsort((place[word[up]], (q - p)[up], src[up]))]
        s = src[up]
        start = np.searchsorted(s, s, side="left")
        up = up[np.arange(len(up)) - start < best]
        terms = words.dictionary.take(pa.array(word[up]))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(up), pa.string()), sources.take(pa.array(src[up])), pa.array(["term"] * len(up), pa.string()), terms, pa.array((p - q)[up])], schema=_FOUND_ARROW)

        # Divergences of sources a < b: dense blocks of shares, at most CELLS numbers each.
        by_term = np.argsort(word, kind="stable")
        word, src, n = word[by_term], src[by_term], n[by_term]
        many = len(sources)
        step = max(1, CELLS // many)
        for first in range(0, many - 1, step):
            past = min(first + step, many)
            found = np.zeros((past - first, many), np.int64)
            for lo in range(0, len(words.dictionary), step):
                hi = min(lo + step, len(words.dictionary))
                a, b = np.searchsorted(word, (lo, hi))
                dense = np.full((many, hi - lo), SMOOTH, np.int64)
                dense[src[a:b], word[a:b] - lo] += n[a:b]
                dense = shares(dense, totals[:, None])
                for i in range(first, past):
                    found[i - first, i + 1 :] += np.abs(dense[i + 1 :] - dense[i]).sum(axis=1)
            for i in range(first, past):
                rest = many - i - 1
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * rest, pa.string()), pa.array([sources[i].as_py()] * rest, pa.string()), pa.array(["pair"] * rest, pa.string()), sources.slice(i + 1), pa.array(found[i - first, i + 1 :])], schema=_FOUND_ARROW)

    return run


def counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` over all rows, written once; the term '' carries each group's number of rows."""
    return settle(partial_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def kept_terms(found: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term, total`` of the terms that at least ``min_docs`` rows of their language hold."""
    return found.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs).select("lang", "term", "total")


def divergences(docs: DataFrame, min_docs: int = 30, best: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources of the language and the terms a source uses more than its language."""
    found = counts(docs)
    kept = settle(kept_terms(found, min_docs), "kept-terms")
    cells = settle(found.join(unless_large(kept.select("lang", "term")), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "kept-counts")
    shards = max(1, -(-cells.count() // SHARD_ROWS))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("in_lang"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = settle(
        found.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "kept", "in_lang")]),
        "source-groups",
    )
    numbers = F.when(F.col("kept") > 0, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array().cast("array<int>"))
    sheets = groups.select("lang", F.explode(numbers).alias("shard"), "source", F.lit("").alias("term"), "n", "kept", "in_lang").unionByName(
        cells.select("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("shard"), "source", "term", "n", F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("in_lang"))
    )
    parts = settle(sheets.groupBy("lang", "shard").applyInArrow(_shard(best), _FOUND), "divergence-parts")

    one = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    idle = groups.where("kept = 0").select("lang", "source")
    # A language without kept terms still lists its sources; these pairs are rows of the result.
    zero = idle.join(idle.select("lang", F.col("source").alias("item")), "lang").where("source < item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    one = one.unionByName(zero)
    pairs = one.unionByName(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast(T.IntegerType()).alias("rank")]
    return ranked.select(*columns).unionByName(terms.select(*columns))
