"""Alpha cleanup, border colour models and sprite bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.operators.ordering import top_k

RGB = ("r", "g", "b")


def binary_alpha(px: DataFrame, threshold: int = 128) -> DataFrame:
    return px.withColumn("a", F.when(F.col("a") >= threshold, 255).otherwise(0).cast("long"))


def color_key(px: DataFrame, key: int, tolerance: int = 18, threshold: int = 128) -> DataFrame:
    """Clear pixels within ``tolerance`` of the key colour; binarise the rest."""
    kr, kg, kb = (key >> 16) & 255, (key >> 8) & 255, key & 255
    d = C.distance_sq((F.col("r"), F.col("g"), F.col("b")), (F.lit(kr), F.lit(kg), F.lit(kb)))
    return px.withColumn("a", F.when(d <= 3 * tolerance * tolerance, 0)
                         .when((F.col("a") > 0) & (F.col("a") >= threshold), 255).otherwise(0).cast("long"))


def decontaminate(px: DataFrame, safe: int = 0, threshold: int = 0) -> DataFrame:
    """Give (near-)transparent pixels a safe colour; ``changed`` marks edited pixels."""
    want = [F.lit(v).cast("long") for v in ((safe >> 16) & 255, (safe >> 8) & 255, safe & 255)]
    gone = (F.col("a") == 0) | (F.col("a") < threshold)
    diff = (F.col("r") != want[0]) | (F.col("g") != want[1]) | (F.col("b") != want[2])
    out = px.withColumn("changed", gone & diff)
    for name, value in zip(RGB, want):
        out = out.withColumn(name, F.when(gone, value).otherwise(F.col(name)))
    return out


def alpha_mode(px: DataFrame, settings: DataFrame) -> DataFrame:
    """Preserve / binary / colour key chosen per asset by ``settings(asset_id, mode, key)``.

    The settings side has one row per asset; Spark broadcasts it only below its size limit.
    """
    j = px.join(settings, "asset_id")
    kr, kg, kb = C.rgb(F.col("key"))
    d = C.distance_sq((F.col("r"), F.col("g"), F.col("b")), (kr, kg, kb))
    hard = F.when(F.col("a") >= 128, 255).otherwise(0)
    new_a = (
        F.when(F.col("mode") == "preserve", F.col("a"))
        .when((F.col("mode") == "colorKey") & (d <= 3 * 18 * 18), 0).otherwise(hard)
    ).cast("long")
    return j.withColumn("a", new_a).drop("key")


def corner_mean(px: DataFrame, size: Column) -> DataFrame:
    """Mean RGBA of the four ``size`` x ``size`` corners; overlaps count once per corner."""
    lo_x, hi_x = F.col("x") < size, F.col("x") >= F.col("w") - size
    lo_y, hi_y = F.col("y") < size, F.col("y") >= F.col("h") - size
    times = (lo_x.cast("long") + hi_x.cast("long")) * (lo_y.cast("long") + hi_y.cast("long"))
    c = px.withColumn("t", times).filter(F.col("t") > 0)
    mean = lambda ch: (F.sum(F.col(ch) * F.col("t")) / F.sum("t")).alias(f"bg_{ch}")
    return c.groupBy("asset_id").agg(*[mean(ch) for ch in ("r", "g", "b", "a")])


def corner_size(cap: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(cap), F.col("w"), F.col("h")))


def sheet_corner_size() -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(12), F.floor(F.least("w", "h") / 24)))


def sprite_bounds(px: DataFrame, tolerance: int = 24, alpha: int = 8) -> DataFrame:
    """Bounding box of pixels unlike the corner background; the full image if none."""
    bg = corner_mean(px, corner_size(12))
    j = px.join(bg, "asset_id")
    d = C.l1(tuple(F.col(c) for c in "rgba"), tuple(F.col(f"bg_{c}") for c in "rgba"))
    fg = (F.col("a") > alpha) & (d > tolerance)
    on = lambda c: F.when(fg, F.col(c))
    agg = j.groupBy("asset_id").agg(
        F.max("w").alias("w"), F.max("h").alias("h"), F.min(on("x")).alias("x0"), F.max(on("x")).alias("x1"),
        F.min(on("y")).alias("y0"), F.max(on("y")).alias("y1"))
    return agg.select(
        "asset_id", F.coalesce("x0", F.lit(0)).alias("bx0"), F.coalesce("y0", F.lit(0)).alias("by0"),
        F.coalesce(F.col("x1") - F.col("x0") + 1, F.col("w")).alias("bw"),
        F.coalesce(F.col("y1") - F.col("y0") + 1, F.col("h")).alias("bh"))


def _border(px: DataFrame, step: Column, corner_twice: bool) -> DataFrame:
    """Border pixels with ``t``, the number of times the border walk visits them."""
    top, side = (F.col("y") == 0) | (F.col("y") == F.col("h") - 1), (F.col("x") == 0) | (F.col("x") == F.col("w") - 1)
    t = (top & (F.col("x") % step == 0)).cast("long")
    if corner_twice:
        t = t + (side & (F.col("y") % step == 0)).cast("long")
    else:
        t = t + (side & ~top & (F.col("y") % step == 0)).cast("long")
    return px.withColumn("t", t).filter(F.col("t") > 0)


def border_model(px: DataFrame, step: int = 1) -> DataFrame:
    """Top two 12-bit buckets of all border pixels (every ``step``-th, if asked); the second is kept if both are bright, neutral and close.

    Ties between buckets go to the lower bucket number.
    """
    b12 = C.bucket12(F.col("r"), F.col("g"), F.col("b"))
    counts = _border(px, F.lit(step), True).groupBy("asset_id", b12.alias("bucket")).agg(
        F.sum("t").alias("n"), *[F.sum(F.col(c) * F.col("t")).alias(f"s{c}") for c in RGB])
    top = top_k(counts, ["asset_id"], [F.desc("n"), F.asc("bucket")], 2)
    m = lambda c: C.rnd(F.col(f"s{c}") / F.col("n"))
    top = top.select("asset_id", "rank", "n", *[m(c).alias(c) for c in RGB])
    pick = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"{c}{k}")
    two = top.groupBy("asset_id").agg(*[pick(c, k) for k in (1, 2) for c in ("n", *RGB)])
    c1, c2 = [tuple(F.col(f"{c}{k}") for c in RGB) for k in (1, 2)]
    b1, b2 = c1[0] + c1[1] + c1[2], c2[0] + c2[1] + c2[2]
    keep = (
        F.col("n2").isNotNull() & (F.col("n2") >= F.col("n1") * F.lit(0.2)) & (b1 > 540) & (b2 > 540)
        & (C.spread(*c1) <= 24) & (C.spread(*c2) <= 24) & (F.abs(b1 - b2) <= 180))
    keep = F.coalesce(keep, F.lit(False))
    return two.select("asset_id", C.pack(*c1).alias("first"), F.when(keep, C.pack(*c2)).alias("second"), F.col("n1"),
                      F.coalesce("n2", F.lit(0)).alias("n2"))


def baked_checker(px: DataFrame) -> DataFrame:
    """Border test for a checkerboard painted in place of transparency."""
    b12 = C.bucket12(F.col("r"), F.col("g"), F.col("b"))
    counts = _border(px, F.lit(1), False).groupBy("asset_id", b12.alias("bucket")).agg(F.sum("t").alias("n"))
    total = counts.groupBy("asset_id").agg(F.sum("n").alias("samples"))
    top = top_k(counts, ["asset_id"], [F.desc("n"), F.asc("bucket")], 2)
    two = top.groupBy("asset_id").agg(*[
        F.coalesce(F.max(F.when(F.col("rank") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for k in (1, 2) for c in ("n", "bucket")])
    def center(c: str):
        b = F.col(c)
        return tuple(F.shiftleft(v, 4) + 8 for v in (F.shiftright(b, 8), F.shiftright(b, 4).bitwiseAND(15), b.bitwiseAND(15)))
    c1, c2 = center("bucket1"), center("bucket2")
    b1, b2 = c1[0] + c1[1] + c1[2], c2[0] + c2[1] + c2[2]
    clear = px.groupBy("asset_id").agg(F.count_if(F.col("a") == 0).alias("transparent"))
    cov = (F.col("n1") + F.col("n2")) / F.col("samples")
    hit = (
        (F.col("transparent") == 0) & (C.spread(*c1) <= 24) & (C.spread(*c2) <= 24) & (b1 > 540) & (b2 > 540) & (cov >= 0.72)
        & (F.col("n2") / F.col("n1") >= 0.2) & F.abs(b1 - b2).between(40, 220))
    return two.join(total, "asset_id").join(clear, "asset_id").select(
        "asset_id", hit.alias("detected"), F.when(F.col("transparent") > 0, F.lit(0.0)).otherwise(F.round(cov, 6)).alias("coverage"))
