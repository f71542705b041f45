"""Ranks and running totals that stay balanced when one key holds most rows.

A window over a hot key sorts the whole key in one task.  Here the key is cut into chunks
that follow the sort order; only per-chunk totals meet in one window, and the rows are
ranked inside their chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rank_in_chunks(df: DataFrame, keys: Sequence[str], chunk: Sequence[str], rest: Sequence[str | Column], name: str) -> DataFrame:
    """``row_number`` over ``keys`` ordered by ``chunk`` then ``rest``.

    ``chunk`` lists the leading sort columns; rows sharing them form one chunk.
    """
    keys, chunk = list(keys), list(chunk)
    totals = df.groupBy(*keys, *chunk).agg(F.count(F.lit(1)).alias("__n"))
    lead = W.partitionBy(*keys).orderBy(*chunk)
    before = totals.select(
        *[F.col(c).alias(f"__k_{c}") for c in keys + chunk],
        (F.sum("__n").over(lead.rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"),
    )
    on = [df[c].eqNullSafe(before[f"__k_{c}"]) for c in keys + chunk]
    inside = F.row_number().over(W.partitionBy(*keys, *chunk).orderBy(*rest))
    return (
        df.withColumn("__in", inside)
        # rows lie by chunk already; a broadcast would take every chunk through the driver
        .join(before.hint("merge"), on[0] if len(on) == 1 else _all(on))
        .withColumn(name, (F.col("__before") + F.col("__in")).cast("long"))
        .drop("__before", "__in", *[f"__k_{c}" for c in keys + chunk])
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, chunk_rows: int = 4096) -> DataFrame:
    """Inclusive running sum of ``value`` over ``keys`` ordered by the integer ``order``."""
    keys = list(keys)
    d = df.withColumn("__v", value).withColumn("__c", F.floor(F.col(order) / chunk_rows))
    before = d.groupBy(*keys, "__c").agg(F.sum("__v").alias("__t"))
    w = W.partitionBy(*keys).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    before = before.withColumn("__before", F.coalesce(F.sum("__t").over(w), F.lit(0))).drop("__t")
    inside = F.sum("__v").over(W.partitionBy(*keys, "__c").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return (
        d.withColumn("__in", inside).join(before, [*keys, "__c"])
        .withColumn(name, F.col("__before") + F.col("__in")).drop("__v", "__c", "__in", "__before")
    )


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: Column, name: str) -> DataFrame:
    """Inclusive running maximum over ``keys`` ordered by ``order``; ``chunk`` must follow that order."""
    keys = list(keys)
    d = df.withColumn("__v", value).withColumn("__c", chunk)
    w = W.partitionBy(*keys).orderBy("__c").rowsBetween(W.unboundedPreceding, -1)
    before = d.groupBy(*keys, "__c").agg(F.max("__v").alias("__t")).withColumn("__before", F.max("__t").over(w)).drop("__t")
    inside = F.max("__v").over(W.partitionBy(*keys, "__c").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return (
        d.withColumn("__in", inside).join(before, [*keys, "__c"])
        .withColumn(name, F.greatest("__before", "__in")).drop("__v", "__c", "__in", "__before")
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  Spark limits each map task to ``k`` rows per key before the
    shuffle (WindowGroupLimit), so a hot key ships at most ``k`` rows per task."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rn.cast("long")).filter(F.col(name) <= k)


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out
