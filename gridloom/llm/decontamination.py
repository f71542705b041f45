"""Benchmark decontamination with DataFrame functions only.

Words are runs of letters and digits, lower-cased; both sides become arrays of five-word shingle
hashes. Fingerprints are 64-bit SimHashes: each bit is the majority over the shingles of a window,
found for all bits at once with bitwise full adders. Window sizes follow the items' sizes
(``CLASSES``): a document has windows of each size at a fixed stride, an item at every offset, so a
passage meets an item window word for word wherever it starts.

Fingerprints within ``RADIUS`` bits agree on at least one of ``RADIUS + 1`` blocks of bits; the
index holds every item window under each of its blocks, so no pair within the radius is missed.
The similarity takes no account of order and no radius is sure for it, so fingerprints alone do not
find all. Items are therefore indexed a second time, by shingles: a window with a similarity of ``t``
holds at least ``t * m`` of an item's ``m`` shingles, so it holds one of any ``m - t * m + 1`` of them;
those that the fewest items have are taken. A document that meets an item in either index is compared.

Windows of the item's size (the whole text, if that is shorter) are compared wherever enough of
their shingles are in the item for the threshold, by weighted Jaccard similarity, the weight of a
shingle being how often it occurs. No window at or over the threshold is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.rows import row_key, settle, text_rows

SHINGLE = 5
# Shingles in a window, stride in documents, least shingles of an item that uses it.
CLASSES = [(15, 4, 21), (7, 2, 9), (3, 2, 5), (1, 1, 1)]
VOTERS = 15
RADIUS = 3
# Index rows (item windows x blocks) up to which the index is sent to every task; a row is under 50 bytes.
INDEX_ROWS = 1_000_000


def with_shingles(rows: DataFrame) -> DataFrame:
    """Replace ``text`` by ``sh``, the hashes of its five-word shingles in order; null text has none."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = rows.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w))).drop("text")
    runs = F.transform(F.sequence(F.lit(0), F.size("_h") - SHINGLE), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(SHINGLE)]))
    return hashed.withColumn("sh", F.when(F.size("_h") >= SHINGLE, runs).otherwise(F.array().cast("array<long>"))).drop("_h")


def _windows(size: int, stride: int) -> Column:
    """All windows of one class, filled up with as many zeros as ones, which leaves the majority as it is."""
    fill = (VOTERS - size) // 2
    pad = F.array(*[F.lit(v).cast("long") for v in [0] * fill + [-1] * fill]) if fill else F.array().cast("array<long>")
    each = F.transform(F.sequence(F.lit(0), F.size("sh") - size, F.lit(stride)), lambda i: F.struct(F.lit(size).alias("size"), i.cast("int").alias("start"), F.concat(F.slice("sh", i + 1, size), pad).alias("w")))
    return F.when(F.size("sh") >= size, each)


def _fingerprint(windows: DataFrame) -> DataFrame:
    """Replace the window ``w`` of 15 hashes by ``fp``, the majority of each bit.

    Full adders count all bits at once; the count's fourth binary digit says that eight or more are set.
    """
    keep = [c for c in windows.columns if c != "w"]
    # Never null, so no null check of the whole bit formula is derived from the join further on.
    df = windows.select(*keep, *[F.coalesce(F.get("w", F.lit(j)), F.lit(0).cast("long")).alias(f"x{j}") for j in range(VOTERS)])

    def add(df: DataFrame, triples: list[tuple[str, str, str]], names: list[tuple[str, str]], rest: list[str]) -> DataFrame:
        cols = []
        for (a, b, c), (s, carry) in zip(triples, names):
            either = F.col(a).bitwiseXOR(F.col(b))
            cols += [either.bitwiseXOR(F.col(c)).alias(s), F.col(a).bitwiseAND(F.col(b)).bitwiseOR(F.col(c).bitwiseAND(either)).alias(carry)]
        return df.select(*keep, *rest, *cols)

    df = add(df, [tuple(f"x{3 * i + j}" for j in range(3)) for i in range(5)], [(f"s{i}", f"c{i}") for i in range(5)], [])
    df = add(df, [("s0", "s1", "s2"), ("c0", "c1", "c2")], [("t0", "d0"), ("u0", "e0")], ["s3", "s4", "c3", "c4"])
    df = add(df, [("s3", "s4", "t0"), ("c3", "c4", "d0")], [("o", "d1"), ("u1", "e1")], ["u0", "e0"])
    df = add(df, [("u0", "u1", "d1")], [("v", "e2")], ["e0", "e1"])
    fp = F.col("e0").bitwiseAND(F.col("e1")).bitwiseOR(F.col("e2").bitwiseAND(F.col("e0").bitwiseXOR(F.col("e1"))))
    return df.select(*keep, fp.alias("fp"))


def _blocks(prints: DataFrame) -> DataFrame:
    """One row per block of the fingerprint: ``key`` tells class, block number and its bits apart."""
    n, wide = RADIUS + 1, 64 // (RADIUS + 1)
    part = [F.shiftrightunsigned("fp", wide * b).bitwiseAND(F.lit((1 << wide) - 1)) + F.lit(b << wide) for b in range(n)]
    keys = F.array(*[p + F.col("size").cast("long") * (n << wide) for p in part])
    return prints.withColumn("key", F.explode(keys))


def _similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    # If one side has no repeats, each shared shingle counts once.
    often = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, g: s + F.least(F.size(F.filter(a, lambda v: v == g)), F.size(F.filter(b, lambda v: v == g))))
    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(often)
    return both / (F.size(a) + F.size(b) - both)


def _rare_shingles(bench: DataFrame, threshold: float) -> DataFrame:
    """``h, item``: of each item so many shingles that any window at the threshold holds one."""
    each = bench.select("item", F.size("sh").alias("m"), F.explode("sh").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    held = each.join(often, "h").groupBy("item", "m").agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("o"))  # one item's shingles
    first = F.col("m") - F.ceil(F.col("m") * threshold - 1e-9).cast("int") + 1
    return held.select("item", F.explode(F.array_distinct(F.transform(F.slice("o", F.lit(1), first), lambda v: v["h"]))).alias("h"))


def _starts(threshold: float) -> tuple[Column, Column, Column]:
    """``need``, ``at`` (places of the item's shingles) and, from those two columns, the starts of all windows of ``sh`` in which enough shingles are in the item ``b`` for the threshold."""
    n, m = F.size("sh"), F.size("b")
    wide = F.least(n, m)
    need = F.greatest(F.ceil((wide + m) * threshold / (1 + threshold) - 1e-9).cast("int"), F.lit(1))
    at = F.filter(F.transform("sh", lambda v, i: F.when(F.array_contains("b", v), i)), lambda i: i.isNotNull())
    # A window with that many holds such a run of places from its first to its last.
    run = lambda i: F.struct(F.greatest(F.get("at", i + F.col("need") - 1) - m + 1, F.lit(0)).alias("lo"), F.least(F.get("at", i), F.greatest(n - m, F.lit(0))).alias("hi"))
    return need, at, F.when(F.size("at") >= F.col("need"), F.array_distinct(F.flatten(F.transform(F.filter(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), run), lambda r: r["lo"] <= r["hi"]), lambda r: F.sequence(r["lo"], r["hi"])))))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, item_id, n_shingles, start, similarity``: one row per document and item that it holds.

    ``start`` is the first word of the most similar window (the first such), ``n_shingles`` the item's size.
    Texts and items under five words, null or empty ones hold nothing and are found nowhere. Items with
    equal texts are reported one by one, repeated rows once. Other columns are ignored.
    """
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    # An item's key holds for null ids and keeps different texts with one id apart.
    bench = bench.withColumn("item", F.struct(F.coalesce("item_id", F.lit(-(1 << 63))).alias("i"), F.xxhash64("text").alias("t")))
    bench = settle(with_shingles(bench).where("size(sh) > 0"), "items")
    kind = F.coalesce(*[F.when(F.size("sh") >= least, F.lit(i)) for i, (_, _, least) in enumerate(CLASSES)])
    used = sorted(r[0] for r in bench.select(kind).distinct().collect())  # at most one row per class
    if not used:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shingles long, start long, similarity double")

    # Written once: fingerprints, shared shingles and the comparison all read these arrays.
    texts = settle(with_shingles(text_rows(docs).select("doc_id", *row_key(), "text")), "document-shingles").where("size(sh) > 0")

    item_windows = None
    for i in used:
        size = CLASSES[i][0]
        part = bench.where(kind == i).select("item", F.size("sh").alias("m"), F.explode(_windows(size, 1)).alias("e")).select("item", "m", "e.*")
        item_windows = part if item_windows is None else item_windows.unionByName(part)
    index = _blocks(_fingerprint(item_windows)).select("key", F.col("fp").alias("item_fp"), "item", "m", F.col("start").alias("offset"))
    index = settle(index, "item-index")
    if index.count() <= INDEX_ROWS:
        index = F.broadcast(index)

    every = F.concat(*[F.coalesce(_windows(*CLASSES[i][:2]), F.array().cast("array<struct<size:int,start:int,w:array<bigint>>>")) for i in used])
    windows = texts.select("_id", "_tx", F.explode(every).alias("e")).select("_id", "_tx", "e.*")
    near = _blocks(_fingerprint(windows)).join(index, "key").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    rare = settle(_rare_shingles(bench, threshold), "item-shingles")
    if rare.count() <= INDEX_ROWS:
        rare = F.broadcast(rare)
    shared = texts.select("_id", "_tx", F.explode(F.array_distinct("sh")).alias("h")).join(rare, "h")
    hits = settle(near.select("_id", "_tx", "item").unionByName(shared.select("_id", "_tx", "item")).distinct(), "candidates")

    held = texts.join(hits.select("_id", "_tx").distinct(), ["_id", "_tx"], "left_semi").dropDuplicates(["_id", "_tx"])  # equal rows once
    sized = bench.select("item", "item_id", F.col("sh").alias("b"))
    if (sized.agg(F.sum(F.size("b"))).first()[0] or 0) <= INDEX_ROWS:
        sized = F.broadcast(sized)
    need, at, starts = _starts(threshold)
    placed = hits.join(sized, "item").join(held, ["_id", "_tx"]).withColumn("need", need).withColumn("at", at).select("doc_id", "item_id", "sh", "b", F.explode(starts).alias("start"))
    placed = placed.select("doc_id", "item_id", "b", "start", F.slice("sh", F.col("start") + 1, F.size("b")).alias("a"))
    scored = placed.select("doc_id", "item_id", F.size("b").cast("long").alias("n_shingles"), F.col("start").cast("long").alias("start"), _similarity(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("first")))
    return scored.groupBy("doc_id", "item_id", "n_shingles").agg(best.alias("best")).select("doc_id", "item_id", "n_shingles", (-F.col("best.first")).alias("start"), F.col("best.similarity").alias("similarity"))
