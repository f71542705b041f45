"""Colour counts and the statistics read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions import color as C
from gridloom.operators.ordering import top_k

VISIBLE_ALPHA = 16
AUTO_COLOR_CAP = 64
AUTO_COLOR_SHARE = 0.985


def _rgb():
    return F.col("r"), F.col("g"), F.col("b")


def visible(px: DataFrame, alpha: int = VISIBLE_ALPHA) -> DataFrame:
    return px.filter(F.col("a") >= alpha)


def histogram(px: DataFrame, keys: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """Exact visible colour counts; ``first_idx`` is the first pixel of the colour."""
    return (
        visible(px).groupBy(*keys, C.pack(*_rgb()).alias("color"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))
    )


def distinct_colors(px: DataFrame) -> DataFrame:
    """Exact visible, exact RGBA, and 5-bit colour counts per asset.

    Colours are reduced to one row each before they are counted, so no asset's pixels meet
    in one task.
    """
    reduced = px.groupBy("asset_id", C.pack(*_rgb()).alias("color"), "a").agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("a") >= VISIBLE_ALPHA
    return reduced.groupBy("asset_id").agg(
        F.countDistinct(F.when(seen, F.col("color"))).alias("exact_visible"),
        F.count(F.lit(1)).alias("exact_rgba"),
        F.countDistinct(C.five_bit(F.col("color"))).alias("bins_all"),
        F.countDistinct(F.when(seen, C.five_bit(F.col("color")))).alias("bins_visible"),
    )


def frequency_palette(hist: DataFrame, n: int, assets: DataFrame | None = None, keys: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """Top ``n`` colours by count then first seen; 5-bit buckets once there are more than
    ``n`` exact colours.  With ``assets`` given, an asset without visible pixels gets black."""
    size = hist.groupBy(*keys).agg(F.count(F.lit(1)).alias("__d"))
    key = F.when(F.col("__d") <= n, F.col("color")).otherwise(C.five_bit(F.col("color")))
    merged = (
        hist.join(size.hint("merge"), list(keys)).groupBy(*keys, key.alias("color"))
        .agg(F.sum("n").alias("n"), F.min("first_idx").alias("first_idx"))
    )
    pal = top_k(merged, keys, [F.desc("n"), F.asc("first_idx")], n, "pos").withColumn("pos", F.col("pos") - 1)
    pal = pal.select(*keys, "pos", "color", "n")
    if assets is None:
        return pal
    black = assets.join(pal.select(*keys).distinct(), list(keys), "left_anti").select(
        *keys, F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("color"), F.lit(0).cast("long").alias("n"))
    return pal.unionByName(black)


def auto_color_count(hist: DataFrame, cap: int = AUTO_COLOR_CAP) -> DataFrame:
    """All colours when they fit ``cap``; else the fewest top colours that reach 98.5 %."""
    total = hist.groupBy("asset_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("exact_colors"))
    top = top_k(hist, ["asset_id"], [F.desc("n"), F.asc("first_idx")], cap)
    run = F.sum("n").over(W.partitionBy("asset_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    reached = top.withColumn("run", run).join(total, "asset_id").filter(F.col("run") / F.col("total") >= AUTO_COLOR_SHARE)
    first = reached.groupBy("asset_id").agg(F.min("rank").alias("k"))
    return total.join(first, "asset_id", "left").select(
        "asset_id", "exact_colors",
        F.when(F.col("exact_colors") <= cap, F.col("exact_colors")).otherwise(F.coalesce("k", F.lit(cap))).cast("long").alias("colors"),
    )


def cumulative_share(hist: DataFrame, k: int = AUTO_COLOR_CAP) -> DataFrame:
    """Running share of the top ``k`` colours of each asset."""
    total = hist.groupBy("asset_id").agg(F.sum("n").alias("total"))
    top = top_k(hist, ["asset_id"], [F.desc("n"), F.asc("first_idx")], k)
    w = W.partitionBy("asset_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return top.withColumn("run", F.sum("n").over(w)).join(total, "asset_id").select(
        "asset_id", "rank", "color", "n", "run", (F.col("run") / F.col("total")).alias("share"))


def palette_preview(px: DataFrame, max_colors: int, unique_cap: int) -> DataFrame:
    """Top colours of a scan that stops at the first pixel bringing colour ``unique_cap + 1``."""
    hist = histogram(px)
    order = top_k(hist, ["asset_id"], ["first_idx"], unique_cap + 1, "seen")
    stop = order.groupBy("asset_id").agg(
        F.max(F.when(F.col("seen") == unique_cap + 1, F.col("first_idx"))).alias("stop"),
        F.least(F.count(F.lit(1)), F.lit(unique_cap)).alias("total_colors"),
    )
    kept = visible(px).join(stop, "asset_id").filter(F.col("stop").isNull() | (F.col("idx") < F.col("stop")))
    counts = kept.groupBy("asset_id", C.pack(*_rgb()).alias("color")).agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"))
    top = top_k(counts, ["asset_id"], [F.desc("n"), F.asc("first_idx")], max_colors)
    cols = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "color"))), lambda s: C.hex_of(s["color"])), " ")
    return top.groupBy("asset_id").agg(cols.alias("colors")).join(stop, "asset_id").select(
        "asset_id", "colors", F.col("total_colors").cast("long").alias("total_colors"), F.col("stop").isNotNull().alias("truncated"))


def alpha_counts(px: DataFrame) -> DataFrame:
    return px.groupBy("asset_id").agg(
        F.count_if(F.col("a") == 0).alias("transparent"), F.count_if((F.col("a") > 0) & (F.col("a") < 255)).alias("soft"))


def dominant_outline(px_edges: DataFrame, hist: DataFrame) -> DataFrame:
    """Near-black colour with the most pixels beside transparency (or the image edge).

    ``px_edges`` holds visible pixels with an ``edge`` flag.
    """
    edges = (
        px_edges.withColumn("color", C.pack(*_rgb())).filter(F.col("edge") & C.near_black(F.col("color")))
        .groupBy("asset_id", "color").agg(F.count(F.lit(1)).alias("edges"))
    )
    total = hist.groupBy("asset_id").agg(F.sum("n").alias("total"))
    cand = hist.join(edges, ["asset_id", "color"]).join(total, "asset_id").filter(
        (F.col("n") >= F.greatest(F.lit(4.0), F.col("total") * 0.02)) & (F.col("edges") / F.col("n") >= 0.35))
    return cand.groupBy("asset_id").agg(
        F.max_by("color", F.struct("edges", "n", -F.col("first_idx"))).alias("outline"))


def vivid_accents(hist: DataFrame, limit: int = 2) -> DataFrame:
    """Most frequent colours with saturation >= 0.62 and at least 1 % (and 4) pixels."""
    total = hist.groupBy("asset_id").agg(F.sum("n").alias("total"))
    r, g, b = C.rgb(F.col("color"))
    vivid = hist.filter(C.saturation(r, g, b) >= 0.62).join(total, "asset_id").filter(
        F.col("n") >= F.greatest(F.lit(4.0), F.col("total") * 0.01))
    return top_k(vivid, ["asset_id"], [F.desc("n"), F.asc("first_idx")], limit).select("asset_id", "rank", "color", "n")


def salient_accents(hist: DataFrame, limit: int = 4) -> DataFrame:
    """Vivid hue clusters by saturation * sqrt(area): one seat per hue family, then by score."""
    total = hist.groupBy("asset_id").agg(F.sum("n").alias("total"))
    r, g, b = C.rgb(F.col("color"))
    sat, val = C.saturation(r, g, b), F.greatest(r, g, b) / F.lit(255.0)
    band = lambda v: F.least(F.lit(3), F.floor(v * 4.0)).cast("long")
    cl = (
        hist.withColumn("sat", sat).filter((F.col("sat") >= 0.33) & (val >= 0.2))
        .groupBy("asset_id", C.hue_sextant(r, g, b).alias("hue"), band(sat).alias("sb"), band(val).alias("vb"))
        .agg(F.sum("n").alias("area"), F.max_by(F.struct("color", "sat"), F.struct("sat", "n", -F.col("first_idx"))).alias("best"))
        .join(total, "asset_id").filter(F.col("area") >= F.greatest(F.lit(8.0), F.col("total") * 0.001))
        .withColumn("score", F.col("best.sat") * F.sqrt(F.col("area").cast("double"))).withColumn("color", F.col("best.color"))
    )
    # at most 6 hues x 4 x 4 bands = 96 clusters per asset reach these windows
    order = [F.desc("score"), F.desc("area"), F.asc("color")]
    fam = F.row_number().over(W.partitionBy("asset_id", "hue").orderBy(*order))
    seated = cl.withColumn("late", F.when(fam == 1, 0).otherwise(1))
    return top_k(seated, ["asset_id"], [F.asc("late"), *order], limit).select("asset_id", "rank", "color", "area", F.round("score", 6).alias("score"))
