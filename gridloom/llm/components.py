"""Connected components over a written edge table, by alternating star steps.

A large-star step links every neighbour above a node to the smallest node around it, a small-star
step does so for the neighbours below (Kiveris et al., 2014). Each round is a grouped minimum
(summed before the shuffle, so a node with very many neighbours costs one row per task) and one
join that adaptive execution may split; rounds end at a checkpoint. Up to ``LOCAL`` edges (16 MB) are
one task's work instead: rounds over few edges cost a table of nearly empty files each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut_lineage

LOCAL = 1 << 20


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free digest of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _tidy(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges in one task: the smaller root takes the larger one."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if a != b:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(find, nodes), pa.int64())], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a, b``); the component is its smallest node."""
    if edges.count() <= LOCAL:
        return edges.select("a", "b").coalesce(1).mapInArrow(_joined, "node long, component long")
    held = cut_lineage(_tidy(edges))
    before = _state(held)
    while before[0]:
        both = held.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(held.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = _tidy(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        below = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(below, large.hi == below.u).select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("m").alias("b")), F.struct(F.col("hi").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        held = cut_lineage(_tidy(small))
        after = _state(held)
        if after == before:
            break
        before = after
    return held.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("component")), F.struct(F.col("lo").alias("node"), F.col("lo").alias("component")))).alias("e")).select("e.*").distinct()
