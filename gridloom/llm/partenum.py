"""Exact n-gram Jaccard join by signatures that say where two sets must agree.

Documents are sets of word shingles. All shingles have one order: common ones, which ``common``
counts, come last and by their number, all others by hash. Take two sets that link at the threshold ``t``
and the first shingle in this order that both hold. At most ``|A| - |A and B|`` shingles of A come before
it, so it lies among the first ``|A| - ceil(t |A|) + 1`` of the larger set and, as the sets then
share ``2t / (1 + t)`` of the smaller one, among the first ``|B| - ceil(2t / (1 + t) |B|) + 1`` of that.
So a set's first shingles are its signatures: those inside the shorter limit are strong, the others weak,
and linked sets share one that is strong in one of them. No set is left out at any size, and the order
decides only how often unlike sets meet: a line or passage that many documents hold is
nobody's signature while rarer shingles are there. Sets so small that only equal sets link have none.

PartEnum, after which the module is named, reaches the same guarantee by enumerating parts of the element domain. It
took 184 signatures a document at 0.85 and 430 at 0.8 and met on any boilerplate line that filled a part.

Equal sets are one node. Sets that share a signature are not paired off with each other: each set
first meets one partner, the member that shares most signatures with others. Verified links make
components; then members are offered, in blocks that double, only to sets that still are in another
component, until no bucket holds two components with an untried pair. The components are those of
all links.

Before two sets are fetched and compared, their cell counts are: elements are counted in ``CELLS`` hash
cells, and the counts of two sets never differ by more, in total, than the sets do. Pairs that
met by chance end there. The rest are compared in stars: the texts of a set and of its partners are dealt
by that set once, and sets are made from texts where they meet, since text packs better than hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.rows import SLICE_BYTES, bundles, map_texts, partitions, settle, text_rows, text_slices, unless_large
from gridloom.llm.textkit import mix, shingles, words

WEAK, STRONG = 0, 1
CELLS = 128
# Shingles in at least so many sets are common; the order knows this many of the most common ones.
COMMON, MOST = 32, 1 << 18
# Shingles that a task gathers before it hands on their counts.
GATHER = 1 << 21
# Partners of one set that are compared in one place.
STAR = 256
_U = np.uint64


class Scheme:
    """Numbers of signatures for a threshold of ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def lengths(self, n: int) -> tuple[int, int]:
        """How many of a set's ``n`` shingles are signatures, and how many of these are strong."""
        if self.den * n < self.num * (n + 1):  # only equal sets link, and those are one node already
            return 0, 0
        return n - -(-self.num * n // self.den) + 1, n - -(-2 * self.num * n // (self.num + self.den)) + 1


class Order:
    """Places of the common shingles, known by their upper 32 bits: after all others, the most common last."""

    def __init__(self, elements: np.ndarray, counts: np.ndarray):
        at = np.lexsort((elements, counts))
        by = np.argsort(elements[at], kind="stable")
        self.elements, self.place = elements[at][by].astype(np.uint32), (by + 1).astype(np.int32)

    def first(self, elements: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` of a set's shingles, which are sorted by hash."""
        top = (elements >> _U(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.elements, top), max(len(self.elements) - 1, 0))
        place = np.where(self.elements[at] == top, self.place[at], 0) if len(self.elements) else np.zeros(len(top), np.int32)
        return elements[np.argsort(place, kind="stable")[:n]] if place.any() else elements[:n]


def signatures(elements: np.ndarray, scheme: Scheme, order: Order | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set of distinct, sorted 64-bit elements, and the role of each."""
    n, strong = scheme.lengths(len(elements))
    return order.first(elements, n) if order else elements[:n], np.where(np.arange(n) < strong, STRONG, WEAK)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``k`` words make one shingle, no words none."""
    hashes, first = words(texts, ascii_lower=True)
    rolled = shingles(hashes, k)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(shingles(hashes[a:b], int(b - a)) ^ _U(b - a))
        else:
            out.append(np.zeros(0, _U))
    return out


def _signed(v: np.ndarray) -> np.ndarray:
    return v.astype(_U).view(np.int64)


class _Sketch:
    """Set size, a 128-bit digest of the set, and its cell counts (one byte each, 255 for more)."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, ids: list, texts: list) -> dict:
        sets = shingle_sets([t or "" for t in texts], self.k)
        sums = [(mix(s).sum(dtype=_U), mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=_U)) for s in sets]
        both = _signed(np.array(sums, _U).reshape(-1, 2))
        cells = [np.minimum(np.bincount((mix(s ^ _U(0x2545F4914F6CDD1D)) % _U(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes() for s in sets]
        return {"row": ids, "n": [len(s) for s in sets], "h1": both[:, 0], "h2": both[:, 1], "cells": cells}


class _Entries:
    """One row per signature."""

    def __init__(self, k: int, num: int, den: int, order: Order):
        self.k, self.scheme, self.order = k, Scheme(num, den), order

    def __call__(self, ids: list, texts: list) -> dict:
        made = [signatures(s, self.scheme, self.order) for s in shingle_sets([t or "" for t in texts], self.k)]
        reps = np.repeat(np.array([i["doc_id"] for i in ids], np.int64), [len(m[0]) for m in made])
        return {"rep": reps, "sig": _signed(np.concatenate([m[0] for m in made])), "role": np.concatenate([m[1] for m in made]).astype(np.int8)}


def _gathered(held: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """Sorted 32-bit values as steps from value to value, one row per range of values that holds any; steps have two bytes where they fit."""
    values = np.sort(np.concatenate(held))
    starts = [(p << 32) // parts for p in range(parts + 1)]
    at = np.searchsorted(values, np.array(starts[:-1], np.uint32)).tolist() + [len(values)]
    rows = []
    for p, (a, b) in enumerate(zip(at, at[1:])):
        if b > a:
            steps = np.diff(values[a:b], prepend=np.uint32(starts[p]))
            small = bool(steps.max() < 1 << 16)
            rows.append((p, small, steps.astype(np.uint16 if small else np.uint32).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary()))], names=["part", "small", "steps"])


def common(texts: DataFrame, k: int) -> Order:
    """The order of the shingles of ``texts``: how many sets hold each is counted over the whole table, by the upper 32 bits of its hash.

    The counts decide which pairs meet, never which link.
    """
    parts = partitions(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in (x for whole in batches for x in text_slices(whole, 0, SLICE_BYTES)):
            for _, some in bundles(batch.column(0).to_pylist()):
                held += [(s >> _U(32)).astype(np.uint32) for s in shingle_sets(some, k)]
                size += sum(len(s) for s in held[-len(some) :])
                if size > GATHER:
                    yield _gathered(held, parts)
                    held, size = [], 0
        if size:
            yield _gathered(held, parts)

    def count(table: pa.Table) -> pa.Table:
        start = (table.column("part")[0].as_py() << 32) // parts
        blobs = zip(table.column("small").to_pylist(), table.column("steps").to_pylist())
        values = np.concatenate([np.cumsum(np.frombuffer(raw, np.uint16 if small else np.uint32), dtype=np.int64) for small, raw in blobs]) + start
        found, n = np.unique(values, return_counts=True)
        return pa.table({"el": pa.array(found[n >= COMMON], pa.int64()), "n": pa.array(n[n >= COMMON], pa.int64())})

    gathered = texts.select("text").mapInArrow(run, "part int, small boolean, steps binary")
    found = settle(gathered.groupBy("part").applyInArrow(count, "el long, n long"), "common")
    level, total = 63, 0
    for row in found.groupBy(F.floor(F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > MOST:
            break
        level = row["level"]
    kept = found.where(F.floor(F.log2("n")) >= level).toArrow()
    return Order(kept.column("el").to_numpy(), kept.column("n").to_numpy())


def _fits(a: str, b: str, num: int, den: int) -> Column:
    """Sizes that sets above the threshold can have; an unknown size fits."""
    return F.coalesce((F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num), F.lit(True))


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _may_link(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose cell counts allow a link."""
    one, two = (members.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("cells").alias(f"c{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = bytes(CELLS)
        for batch in batches:
            na, nb = (batch.column(i).fill_null(-1).to_numpy() for i in (2, 3))
            x, y = (np.frombuffer(b"".join(v or none for v in batch.column(i).to_pylist()), np.uint8).reshape(-1, CELLS) for i in (4, 5))
            apart = np.abs(x.astype(np.int16) - y).sum(axis=1, dtype=np.int64)
            keep = (na < 0) | (nb < 0) | (apart * (den + num) <= (na + nb) * (den - num))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=_PAIR).filter(pa.array(keep))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a long, b long")


def _linked(k: int, num: int, den: int):
    """Pairs that link, from rows ``star, slot, doc_id, text`` sorted by star and slot: an even slot brings the star's own sets, the odd one above it their partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in (x for whole in batches for x in text_slices(whole, 3, SLICE_BYTES)):
            stars, slots, ids = (batch.column(i).to_pylist() for i in range(3))
            found = []
            for start, some in bundles(batch.column(3).to_pylist()):
                for i, x in enumerate(shingle_sets(some, k), start):
                    key = (stars[i], slots[i] >> 1)
                    if key != at:
                        at, held = key, {}
                    if slots[i] & 1 == 0:
                        held[x.tobytes()] = x
                        continue
                    for y in held.values():
                        m, n = len(x), len(y)
                        if den * m >= num * n and den * n >= num * m:
                            both = len(np.intersect1d(x, y, assume_unique=True))
                            if den * both >= num * (m + n - both):
                                found.append((stars[i], ids[i]))
                                break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=_PAIR)

    return run


def _verify(pairs: DataFrame, members: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs ``a, b`` whose sets link: ``den * |A and B| >= num * |A or B|``."""
    pairs = settle(_may_link(pairs, members, num, den), "near")
    stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("places"))
    partners = pairs.join(stars, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("star"), (2 * F.pmod(F.xxhash64("b"), F.col("places")) + 1).cast("int").alias("slot"))
    own = stars.select(F.col("a").alias("doc_id"), F.col("a").alias("star"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place")).select("doc_id", "star", (2 * F.col("place")).alias("slot"))
    visits = settle(partners.unionByName(own), "visits")
    met = texts.join(unless_large(visits, 1_000_000), "doc_id").select("star", "slot", "doc_id", "text")
    dealt = met.repartition(F.col("star"), F.shiftright("slot", 1)).sortWithinPartitions("star", "slot")
    return dealt.mapInArrow(_linked(k, num, den), "a long, b long").distinct()


NODE = "_node"


def free_name(docs: DataFrame, name: str = NODE) -> str:
    """``name``, with underscores before it until no column of ``docs`` is called so (case aside)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def with_nodes(docs: DataFrame, node: str = NODE) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a column ``node`` that is never null, and the rows without an id, if there are any.

    ``docs`` must not have a column of that name: ``free_name`` gives one.

    A row's node is its id. Each row without an id is a document of its own: it gets a number above all
    ids (below them, where ids use the upper half), and is written with it so that the number stays.
    """
    without = docs.where(F.col("doc_id").isNull())
    if without.isEmpty():
        return docs.withColumn(node, F.col("doc_id").cast("long")), None
    top = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    base = 1 << 62 if top is None or top < 1 << 62 else -(1 << 63)
    numbered = settle(without.withColumn(node, F.lit(base) + F.monotonically_increasing_id()), "no-id")
    return docs.where(F.col("doc_id").isNotNull()).withColumn(node, F.col("doc_id").cast("long")).unionByName(numbered), numbered


def similar_classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per input row.

    Null, empty and blank texts have the empty set and link with nothing: their component is their
    own id. Rows with equal ids are one document and share a component. Each row without an id is a
    document of its own; a component of such rows only has a null ``component_id``. Other columns are ignored.
    """
    rows, numbered = with_nodes(text_rows(docs))
    classes = node_classes(rows.select(F.col("_node").alias("doc_id"), "text"), k, num, den)
    if numbered is None:
        return classes
    own = unless_large(settle(numbered.select("_node"), "no-id-nodes"))
    for c in ("doc_id", "component_id"):
        classes = classes.join(own.withColumnRenamed("_node", "_own"), F.col(c) == F.col("_own"), "left").withColumn(c, F.when(F.col("_own").isNull(), F.col(c))).drop("_own")
    return classes


def node_classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """As ``similar_classes``, for ids that are never null."""
    rows = text_rows(docs).select(F.struct("doc_id", F.xxhash64("text").alias("tx")).alias("doc_id"), "text")
    sketched = settle(map_texts(rows, _Sketch(k), "row struct<doc_id: long, tx: long>, n long, h1 long, h2 long, cells binary").select("row.*", "n", "h1", "h2", "cells"), "sketches")
    some = sketched.where("n > 0")
    # Copies are counted before the shuffle; their first stands for all.
    nodes = settle(some.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("cells").alias("cells")), "nodes")
    copies = some.drop("cells").join(nodes.where("copies > 1").drop("cells"), ["h1", "h2", "n"]).where("doc_id <> rep").select("doc_id", "tx").distinct()
    keyed = rows.select("doc_id.*", "text")
    firsts = keyed.join(unless_large(settle(copies, "copies")), ["doc_id", "tx"], "left_anti").select(F.struct("doc_id", "tx").alias("doc_id"), "text")
    entries = map_texts(firsts, _Entries(k, num, den, common(firsts, k)), "rep long, sig long, role tinyint")
    bucket = Window.partitionBy("sig")
    counted = entries.withColumn("size", F.count(F.lit(1)).over(bucket)).withColumn("most", F.max("role").over(bucket))
    shared = settle(counted.where(F.col("size") > 1).where(F.col("most") == STRONG).select("sig", "rep", "role", "size"), "buckets")

    # One id with several texts has no one size.
    alike = lambda c: F.when(F.count(F.lit(1)) == 1, F.first(c)).alias(c)
    sizes = nodes.groupBy("rep").agg(alike("n"), alike("cells"))
    degree = shared.groupBy("rep").agg(F.sum(F.col("size") - 1).alias("degree"))
    members = settle(degree.join(sizes, "rep"), "members")

    # A bucket's offers are its first members; two weak ones need not meet.
    offering = F.col("role") == STRONG
    first = bucket.orderBy(~offering, F.desc("degree"), "rep")
    ranked = shared.join(members.drop("cells"), "rep").withColumn("pos", F.row_number().over(first)).withColumn("offers", F.sum(offering.cast("int")).over(bucket))
    for c in ("rep", "n", "degree"):
        ranked = ranked.withColumn(f"top_{c}", F.first(c).over(first))
    ranked = settle(ranked, "ranked")
    partner = F.max(F.struct("top_degree", "top_rep")).alias("p")
    pairs = ranked.where("pos > 1 AND rep <> top_rep").where(_fits("n", "top_n", num, den)).groupBy(F.col("rep").alias("b")).agg(partner).select(F.col("p.top_rep").alias("a"), "b")
    edges = settle(_verify(pairs, members, keyed, k, num, den), "links")

    live = ranked.select("sig", "rep", "n", "pos", "size", "offers")
    label = members.select(F.col("rep").alias("node"))
    low, high = 1, 1
    while True:
        label = settle(label.select("node").join(components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")
        tagged = live.join(label.withColumnRenamed("node", "rep"), "rep")
        mixed = tagged.withColumn("least", F.min("component").over(bucket)).withColumn("most", F.max("component").over(bucket))
        # A bucket with one component stays so.
        open_rows = settle(mixed.where("least < most").where((F.col("size") > low) & (F.col("offers") >= low)).drop("least", "most"), "open")
        if open_rows.isEmpty():
            break
        offer = open_rows.where(F.col("pos").between(low, high) & (F.col("pos") <= F.col("offers"))).select("sig", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"))
        meet = open_rows.select("sig", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb")).join(offer, "sig")
        pairs = settle(meet.where("pb > pa AND ca <> cb").where(_fits("na", "nb", num, den)).select("a", "b").distinct(), "pairs")
        edges = settle(edges.unionByName(_verify(pairs, members, keyed, k, num, den)), "links")
        live = open_rows.drop("component")
        low, high = high + 1, 2 * high + 1

    reps = nodes.select("h1", "h2", "n", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    linked = some.drop("cells").join(reps, ["h1", "h2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = sketched.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
