"""Neighbour values of dense rasters.

A window per image row gives left and right; a second window per image column gives the
rows above and below.  Partitions are single rows or columns, so a huge image is spread
over as many tasks as it has lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

def row_window():
    return W.partitionBy("asset_id", "y").orderBy("x")


def column_window():
    return W.partitionBy("asset_id", "x").orderBy("y")


def neighbours4(px: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds ``{name}_l/_r/_u/_d``; null outside the image."""
    return (
        px.withColumn("__v", value)
        .withColumn(f"{name}_l", F.lag("__v").over(row_window())).withColumn(f"{name}_r", F.lead("__v").over(row_window()))
        .withColumn(f"{name}_u", F.lag("__v").over(column_window())).withColumn(f"{name}_d", F.lead("__v").over(column_window()))
        .drop("__v")
    )


def neighbours8(px: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds ``{name}_00 .. {name}_22`` (row, column of the 3x3 block); null outside."""
    row = px.withColumn("__v", value).withColumn(
        "__t", F.struct(F.lag("__v").over(row_window()).alias("c0"), F.col("__v").alias("c1"), F.lead("__v").over(row_window()).alias("c2")))
    three = row.withColumn("__up", F.lag("__t").over(column_window())).withColumn("__dn", F.lead("__t").over(column_window()))
    for i, src in enumerate(("__up", "__t", "__dn")):
        for j in range(3):
            three = three.withColumn(f"{name}_{i}{j}", F.col(f"{src}.c{j}"))
    return three.drop("__v", "__t", "__up", "__dn")


def box(px: DataFrame, value: Column, radius: int, agg, name: str) -> DataFrame:
    """Separable aggregate (max, min, sum) of ``value`` over a (2r+1)^2 square clipped to the image."""
    return (
        px.withColumn("__v", value).withColumn("__v", agg("__v").over(row_window().rowsBetween(-radius, radius)))
        .withColumn(name, agg("__v").over(column_window().rowsBetween(-radius, radius))).drop("__v")
    )


def transparent_boundary(px: DataFrame, alpha: int = 16) -> DataFrame:
    """``edge``: on the image border or beside a pixel with less alpha than ``alpha``."""
    n = neighbours4(px, F.col("a"), "na")
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("w") - 1) | (F.col("y") == F.col("h") - 1)
    low = F.coalesce(F.least(*[F.col(f"na_{s}") for s in "lrud"]) < alpha, F.lit(False))
    return n.withColumn("edge", border | low).drop(*[f"na_{s}" for s in "lrud"])
