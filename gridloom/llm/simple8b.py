"""Token ids in word-aligned binary files (Simple-8b family).

A 64-bit word holds a 4-bit selector and 60 bits of payload. Selectors 0..13 pack as many ids
as fit at one bit width, selector 14 is a run of one id, selector 15 is an escape: its payload
says how many raw 64-bit words follow, for ids that need more than 60 bits. Ids are cut into
blocks of ``BLOCK`` ids; the header has the first word of every block, so blocks decode alone and
all blocks decode together: counts per word give output places by one prefix sum, and the
words of each selector are unpacked as one numpy matrix.

A file is a sequence of chunks. A chunk holds whole documents: directory (doc_id, ids), block
offsets, words. The files are rows ``(shard, seq, ...)`` of a table that Spark writes, so any store
Spark can reach will do. Shards are ranges of doc_id, in ascending order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.rows import scratch_path, text_rows
from gridloom.llm.tokens import encoder

MAGIC = b"W8B1"
BLOCK = 1024
CHUNK_IDS = 1 << 17
# Ids in a word and bits of each, by selector.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
RUN, ESCAPE = 14, 15
RUN_BITS, RUN_LEAST = 20, 12
_U = np.uint64


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, at least 1."""
    if ids.max() < 1 << 53:  # exact as doubles
        return np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)
    w = np.ones(len(ids), np.uint8)
    left = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = left >= _U(1 << step)
        w += big.astype(np.uint8) * np.uint8(step)
        left = np.where(big, left >> _U(step), left)
    return w


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``ids`` (unsigned 64-bit) and the first word of each block.

    All blocks are encoded at once: for each place the widest pack that fits is known from
    window maxima, then every block steps through its own places in lockstep.
    """
    ids = np.ascontiguousarray(ids, _U)
    n = len(ids)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    width = _widths(ids)
    place = np.arange(n)
    ends = np.minimum((place // BLOCK + 1) * BLOCK, n)
    room = ends - place
    change = np.concatenate((ids[1:] != ids[:-1], [True]))
    stops = np.flatnonzero(change) + 1
    run = np.minimum(np.repeat(stops, np.diff(stops, prepend=0)) - place, room)
    run = np.minimum(run, (1 << RUN_BITS) - 1)
    # Blocks as rows, with places of no width behind them: a window never sees the next block.
    blocks = -(-n // BLOCK)
    held = np.zeros((blocks, BLOCK + PACKS[0][0]), np.uint8)
    held[:, :BLOCK] = np.concatenate((width, np.zeros(blocks * BLOCK - n, np.uint8))).reshape(blocks, BLOCK)
    widest = {1: held}
    for p in (2, 4, 8, 16, 32):
        half = widest[p // 2]
        widest[p] = half.copy()
        np.maximum(half[:, : -(p // 2)], half[:, p // 2 :], out=widest[p][:, : -(p // 2)])
    pick = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    for sel in range(len(PACKS) - 1, -1, -1):  # the largest count wins, so it is written last
        count, bits = PACKS[sel]
        p = 1 << (count.bit_length() - 1)
        # The last word of a block may be short: its free places stay zero.
        most = np.maximum(widest[p][:, :BLOCK], widest[p][:, count - p : count - p + BLOCK])
        np.copyto(pick, np.uint8(sel), where=most <= bits)
    choice = pick.ravel()[:n].astype(np.int64)
    take = np.minimum(np.array([c for c, _ in PACKS] + [1, 1], np.int64)[choice], room)
    runs = (run >= RUN_LEAST) & (run > take) & (width <= 60 - RUN_BITS)
    choice[runs], take[runs] = RUN, run[runs]
    at = np.arange(0, n, BLOCK)
    stop = np.minimum(at + BLOCK, n)
    live = np.arange(len(at))
    picks = []
    while len(live):
        picks.append((live, at[live]))
        at[live] += take[at[live]]
        live = live[at[live] < stop[live]]
    place = np.sort(np.concatenate([p for _, p in picks]))
    sel, cnt = choice[place], take[place]
    size = np.where(sel == ESCAPE, 2, 1)
    offset = np.concatenate(([0], np.cumsum(size)))
    words = np.zeros(offset[-1], _U)
    padded = np.concatenate((ids, np.zeros(PACKS[0][0], _U)))
    for s, (count, bits) in enumerate(PACKS):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            take_at, payload = place[rows], np.zeros(len(rows), _U)
            for j in range(count):
                payload |= padded[take_at + j] << _U(j * bits)
            # What follows a short word's own ids is cut off.
            words[offset[rows]] = (payload & ((_U(1) << (cnt[rows] * bits).astype(_U)) - _U(1))) | _U(s << 60)
    rows = np.flatnonzero(sel == RUN)
    words[offset[rows]] = (cnt[rows].astype(_U) << _U(60 - RUN_BITS)) | ids[place[rows]] | _U(RUN << 60)
    rows = np.flatnonzero(sel == ESCAPE)
    words[offset[rows]] = _U((ESCAPE << 60) | 1)
    words[offset[rows] + 1] = ids[place[rows]]
    return words, offset[np.searchsorted(place, np.arange(0, n, BLOCK))]


def decode(words: np.ndarray, n: int, blocks: np.ndarray) -> np.ndarray:
    """The ``n`` ids of ``words``; ``blocks`` has the first word of each block."""
    if not n:
        return np.zeros(0, _U)
    sel = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for e in np.flatnonzero(sel == ESCAPE):
        if not raw[e]:
            raw[e + 1 : e + 1 + int(words[e] & _U((1 << 60) - 1))] = True
    head = ~raw
    payload = words & _U((1 << 60) - 1)
    holds = np.array([c for c, _ in PACKS] + [0, 0], np.int64)[sel]
    runs = sel == RUN
    holds = np.where(runs, (payload >> _U(60 - RUN_BITS)).astype(np.int64), holds)
    holds = np.where(sel == ESCAPE, payload.astype(np.int64), holds)
    holds = np.where(raw, 0, holds)
    before = np.concatenate(([0], np.cumsum(holds)))[:-1]
    # A block's last word may hold more places than ids are left: places are counted from the block.
    block = np.searchsorted(blocks, np.arange(len(words)), side="right") - 1
    start = before - before[blocks][block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, _U)
    for s, (count, bits) in enumerate(PACKS):
        rows = np.flatnonzero(head & (sel == s))
        if len(rows):
            full = stop[rows] - start[rows] >= count
            take, first = payload[rows[full]], start[rows[full]]
            for j in range(count):
                out[first + j] = (take >> _U(j * bits)) & _U((1 << bits) - 1)
            rows = rows[~full]  # the last words of blocks
            part = (payload[rows][:, None] >> (np.arange(count, dtype=_U) * _U(bits))) & _U((1 << bits) - 1)
            place = start[rows][:, None] + np.arange(count)
            inside = place < stop[rows][:, None]
            out[place[inside]] = part[inside]
    for r in np.flatnonzero(head & runs):
        out[start[r] : start[r] + holds[r]] = payload[r] & _U((1 << (60 - RUN_BITS)) - 1)
    for e in np.flatnonzero(head & (sel == ESCAPE)):
        out[start[e] : start[e] + holds[e]] = words[e + 1 : e + 1 + holds[e]]
    return out


def write_chunk(docs: list[tuple[int | None, bytes]]) -> bytes:
    """One chunk of whole documents (ids packed as little-endian unsigned 32-bit integers): header, directory, block offsets, words."""
    ids = np.frombuffer(b"".join(i for _, i in docs), "<u4").astype(_U)
    words, blocks = encode(ids)
    known = np.array([d is not None for d, _ in docs], np.uint8)
    names = np.array([d or 0 for d, _ in docs], "<i8")
    sizes = np.array([len(i) // 4 for _, i in docs], "<u8")
    return b"".join((MAGIC, struct.pack("<QQQ", len(docs), len(ids), len(words)), known.tobytes(), names.tobytes(), sizes.tobytes(), blocks.astype("<u8").tobytes(), words.astype("<u8").tobytes()))


def read_chunk(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids of the documents, how many token ids each has, and all token ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a chunk of this format")
    n_docs, n_ids, n_words = struct.unpack_from("<QQQ", data, 4)
    at = 28

    def part(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, n, at)
        at += got.nbytes
        return got

    known, names, sizes = part("u1", n_docs), part("<i8", n_docs), part("<u8", n_docs)
    blocks, words = part("<u8", -(-n_ids // BLOCK)), part("<u8", n_words)
    ids = decode(words.astype(_U), n_ids, blocks.astype(np.int64))
    return [int(d) if k else None for k, d in zip(known, names)], sizes.astype(np.int64), ids


FILE_SCHEMA = "shard int, seq int, first_id long, n_docs long, ids_before long, n_ids long, data binary"
_FILE_ARROW = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
_DOC_ARROW = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, chunk_ids: int = CHUNK_IDS) -> None:
    """Tokenise, close each document with ``end_id`` and write the chunk table to ``folder``.

    Texts, not ids, are dealt by doc_id ranges; each task sorts its range, then encodes and packs
    it in one pass, holding one chunk at a time. Null text counts as empty. Equal ids are
    ordered by text. A task that is run again writes the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held, size, seq, before, shard = encoder(tokenizer), [], 0, 0, 0, 0
        end = end_id.to_bytes(4, "little")

        def close() -> pa.RecordBatch:
            nonlocal held, size, seq, before
            row = [[shard], [seq], [held[0][0]], [len(held)], [before], [size], [write_chunk(held)]]
            held, seq, before, size = [], seq + 1, before + size, 0
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(row, _FILE_ARROW)], schema=_FILE_ARROW)

        for batch in batches:
            for doc, text, shard in zip(*(c.to_pylist() for c in batch.columns)):
                ids = enc.pack(text or "") + end
                held.append((doc, ids))
                size += len(ids) // 4
                if size >= chunk_ids:
                    yield close()
        if held:
            yield close()

    dealt = text_rows(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())
    dealt.mapInArrow(run, FILE_SCHEMA).write.parquet(folder)


def read_files(spark, folder: str) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids_crc32``, decoded chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, data in zip(*(c.to_pylist() for c in batch.columns)):
                names, sizes, ids = read_chunk(data)
                ends = np.cumsum(sizes)
                flat = ids.astype("<u4")
                crc = [zlib.crc32(flat[e - s : e].tobytes()) for s, e in zip(sizes, ends)]
                cols = [[shard] * len(names), names, before + ends - sizes, sizes, crc]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(cols, _DOC_ARROW)], schema=_DOC_ARROW)

    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    # One row per shard, as many as there are partitions: the running sum needs no split.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.min("first_id").alias("lo"))
    bases = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    rows = files.select("shard", "ids_before", "data").mapInArrow(run, "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files and return what they hold."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "ids")
    write_files(docs, tokenizer, end_id, folder)
    return read_files(spark, folder)
