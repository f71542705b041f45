"""Best-fit packing with large-item matching, planned on counts of lengths.

Lengths are whole numbers up to the capacity, so the numbers of pieces per length are a table of
at most ``capacity`` rows, whatever the input. The plan is made on that table:

1. pieces above one third of the capacity are matched, largest first, each with the largest
   other large piece that still fits, so a sequence holds at most two of them;
2. smaller pieces, largest first, go to the smallest remaining gap that takes them, and to new
   sequences when none does.

Both steps move whole runs of equal pieces over whole runs of equal sequences, so the plan is a
short list of segments (its length depends on the capacity alone). Pieces then find their place by
their rank among pieces of the same length: ranks are counted in buckets, so one length that a
third of all pieces share is still dealt over many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.rows import map_texts, partitions, settle, text_rows
from gridloom.llm.tokens import encoder

PIECE_SCHEMA = "doc_id long, tx long, piece int, start long, length long, ids_crc32 long"
SEGMENT_SCHEMA = "length long, rank_lo long, rank_hi long, seq_lo long, per_seq long, offset_lo long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments ``(length, rank_lo, rank_hi, seq_lo, per_seq, offset_lo)``.

    Piece ``r`` of a length, ``rank_lo <= r < rank_hi``, goes to sequence
    ``seq_lo + (r - rank_lo) // per_seq`` at ``offset_lo + (r - rank_lo) % per_seq * length``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of sequences (first, number)
    sizes: list[int] = []  # gaps in use, ascending

    def put(length: int, first: int, number: int, per: int, offset: int) -> None:
        out.append((length, used[length], used[length] + number * per, first, per, offset))
        used[length] += number * per
        left[length] -= number * per

    def open_gap(gap: int, first: int, number: int) -> None:
        if gap > 0 and number > 0:
            if not gaps[gap]:
                insort(sizes, gap)
            gaps[gap].append((first, number))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1  # largest that still fits beside a
        b = large[at] if at >= 0 else None
        if b == a and left[a] == 1:
            b = large[at - 1] if at >= 1 else None
        number = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
        put(a, bins, number, 1, 0)
        if b is not None:
            put(b, bins, number, 1, a)
        open_gap(capacity - a - (b or 0), bins, number)
        bins += number
        large = [n for n in large if left[n] > 0]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n] > 0:
            at = bisect_left(sizes, n)
            gap = sizes[at] if at < len(sizes) else capacity
            per = gap // n
            if at < len(sizes):
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
            else:
                first, number = bins, -(-left[n] // per)
                bins += number
            full = min(number, left[n] // per)
            if full:
                put(n, first, full, per, capacity - gap)
                open_gap(gap - per * n, first, full)
            rest = left[n] if full < number else 0
            if rest:
                put(n, first + full, 1, rest, capacity - gap)
                open_gap(gap - rest * n, first + full, 1)
                full += 1
            open_gap(gap, first + full, number - full)
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Token pieces of at most ``capacity`` ids: only longer documents are cut, null text counts as empty."""
    end = end_id.to_bytes(4, "little")

    def run(keys: list, texts: list) -> dict:
        enc, rows = encoder(tokenizer), []
        for key, text in zip(keys, texts):
            packed = enc.pack(text or "") + end
            mark = zlib.crc32((text or "").encode("utf-8", "replace"))
            for i, at in enumerate(range(0, len(packed), 4 * capacity)):
                part = packed[at : at + 4 * capacity]
                rows.append((key, mark, i, at // 4, len(part) // 4, zlib.crc32(part)))
        cols = list(zip(*rows)) if rows else [[] for _ in range(6)]
        return dict(zip(("doc_id", "tx", "piece", "start", "length", "ids_crc32"), cols))

    return map_texts(text_rows(docs), run, PIECE_SCHEMA)


def pack(items: DataFrame, capacity: int, order: list[str], bucket_rows: int = 50_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to ``capacity``.

    ``order`` names columns that tell rows of equal length apart; rows equal in all of them may
    swap places. ``items`` is read several times, so pass a written table.
    """
    spark = items.sparkSession
    histogram = items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in histogram}
    segments = spark.createDataFrame(plan(counts, capacity), SEGMENT_SCHEMA)
    n_buckets = max(4 * partitions(spark), -(-sum(counts.values()) // bucket_rows))
    # xxhash64 of the order columns deals a length over buckets; ranks run inside (length, bucket).
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("int"))
    totals = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = totals.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1
    ranked = dealt.withColumn("rank", rank).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    # The segment list depends on the capacity alone, never on the number of rows.
    s, r = F.broadcast(segments).alias("s"), ranked.alias("r")
    hit = (F.col("s.length") == F.col("r.length")) & (F.col("r.rank") >= F.col("s.rank_lo")) & (F.col("r.rank") < F.col("s.rank_hi"))
    step = F.col("r.rank") - F.col("s.rank_lo")
    seq = F.col("s.seq_lo") + F.floor(step / F.col("s.per_seq"))
    offset = F.col("s.offset_lo") + F.pmod(step, F.col("s.per_seq")) * F.col("r.length")
    return r.join(s, hit).select(*[F.col(f"r.{c}") for c in items.columns], seq.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece with its place.

    Empty table: no rows. Repeated rows are packed each for itself. Very long texts become
    several full pieces.
    """
    # The number tells copies of a row apart, so they don't meet in one bucket; it is written and stays.
    cut = settle(pieces(docs, tokenizer, end_id, capacity).withColumn("nr", F.monotonically_increasing_id()), "pieces")
    return pack(cut, capacity, ["doc_id", "tx", "piece", "nr"]).drop("tx", "nr")
