"""Neutral grey left around an outline takes the outline's colour, on the outer side only.

The nearest outline pixel within four pixels is found separably: the nearest one in each image
column first (running minima over nine rows), then the best of nine columns. Evidence that the grey
was there before comes from floods of the source and of the raster before outlining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.operators.components import components
from gridloom.operators.ordering import top_k
from gridloom.operators.stencil import column_window, row_window
from gridloom.session import cut_lineage

# Fixed values of the rule; luma counts in thousandths, so that comparisons are exact.
ALPHA, RADIUS, BACKGROUND_DISTANCE, BRIGHT = 8, 4, 30, 232
SHELL_SPREAD, PASS_SPREAD, MIN_LUMA, MAX_LUMA, PASS_LUMA, DARK_LUMA = 28, 32, 35, 165, 252, 34
SHELL_NEAR, OUTLINE_NEAR = 14, 16
FACTS = "asset_id long, outline long, rect_x long, rect_y long, rect_w long, rect_h long, offset_x long, offset_y long"


def _luma() -> Column:
    return F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114


def _near(color: Column, delta: int) -> Column:
    return C.max_channel_delta((F.col("r"), F.col("g"), F.col("b")), C.rgb(color)) <= delta


def _spread() -> Column:
    return C.spread(F.col("r"), F.col("g"), F.col("b"))


def shell() -> Column:
    """Neutral, of middle brightness and unlike the outline (column ``outline``)."""
    return (F.col("a") >= ALPHA) & ~_near(F.col("outline"), SHELL_NEAR) & (_spread() <= SHELL_SPREAD) & _luma().between(MIN_LUMA * 1000, MAX_LUMA * 1000)


def outline_like() -> Column:
    return (F.col("a") >= ALPHA) & (_near(F.col("outline"), OUTLINE_NEAR) | (_luma() <= DARK_LUMA * 1000))


def border_color(px: DataFrame) -> DataFrame:
    """``asset_id, border``: mean colour of the fullest 12-bit bucket of visible border pixels; corners count twice."""
    t = ((F.col("y") == 0) | (F.col("y") == F.col("h") - 1)).cast("long") + ((F.col("x") == 0) | (F.col("x") == F.col("w") - 1)).cast("long")
    b12 = C.bucket12(F.col("r"), F.col("g"), F.col("b"))
    one = px.withColumn("t", t).where((F.col("t") > 0) & (F.col("a") >= ALPHA)).groupBy("asset_id", b12.alias("bucket")).agg(F.sum("t").alias("n"), *[F.sum(F.col(c) * F.col("t")).alias(c) for c in "rgb"])
    return top_k(one, ["asset_id"], [F.desc("n"), "bucket"], 1).select("asset_id", C.pack(*[C.rnd(F.col(c) / F.col("n")) for c in "rgb"]).alias("border"))


def evidence(px: DataFrame, facts: DataFrame, bright: bool, in_rect: bool) -> DataFrame:
    """``asset_id, x, y`` of shell pixels of ``px`` that the outside reaches, eight ways, through clear, background-like, green or neutral pixels.

    With ``in_rect`` the flood starts at the border of the asset's rectangle and stays inside it.
    """
    d = px.select("asset_id", "idx", "x", "y", "w", "h", "r", "g", "b", "a").join(facts, "asset_id").join(border_color(px), "asset_id", "left")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    like = F.coalesce(C.distance_sq((r, g, b), C.rgb(F.col("border"))) <= BACKGROUND_DISTANCE**2, F.lit(False))
    green = (g * 100 > r * 103) & (g * 100 > b * 103) & ((g - r >= 2) | (g - b >= 2))
    neutral = (_spread() <= PASS_SPREAD) & _luma().between(MIN_LUMA * 1000, PASS_LUMA * 1000)
    passes = (F.col("a") < ALPHA) | like | green | neutral
    if bright:
        passes = passes | ((r >= BRIGHT) & (g >= BRIGHT) & (b >= BRIGHT))
    zero = F.lit(0)
    lo_x, lo_y, hi_x, hi_y = (zero, zero, F.col("w"), F.col("h")) if not in_rect else (F.col("rect_x"), F.col("rect_y"), F.col("rect_x") + F.col("rect_w"), F.col("rect_y") + F.col("rect_h"))
    inside = (F.col("x") >= lo_x) & (F.col("y") >= lo_y) & (F.col("x") < hi_x) & (F.col("y") < hi_y)
    edge = (F.col("x") == lo_x) | (F.col("y") == lo_y) | (F.col("x") == hi_x - 1) | (F.col("y") == hi_y - 1)
    lab = cut_lineage(components(d.withColumns({"edge": edge, "shell": shell()}), F.when(inside & passes, 1), 8).select("asset_id", "x", "y", "component", "edge", "shell"))
    open_ = lab.where("edge").select("asset_id", "component").distinct()
    return lab.where("shell").join(open_, ["asset_id", "component"], "left_semi").select("asset_id", "x", "y")


def nearest_outline(px: DataFrame) -> DataFrame:
    """``ox, oy``: nearest outline-like pixel within ``RADIUS``, first in scan order among equal ones; null if none. Needs ``on``."""
    col = column_window()
    here = F.when(F.col("on"), F.col("y"))
    up, down = F.max(here).over(col.rowsBetween(-RADIUS, 0)), F.min(here).over(col.rowsBetween(0, RADIUS))
    d = px.withColumns({"__u": up, "__v": down})
    # The upper one wins where both are equally far: it comes first in scan order.
    d = d.withColumn("__c", F.when(F.col("__v").isNull() | (F.col("y") - F.col("__u") <= F.col("__v") - F.col("y")), F.col("__u")).otherwise(F.col("__v")))
    row = row_window()

    near = {f"__n{s + RADIUS}": F.lag("__c", -s).over(row) if s < 0 else F.lead("__c", s).over(row) if s else F.col("__c") for s in range(-RADIUS, RADIUS + 1)}
    d = d.withColumns(near)
    cands = []
    for s in range(-RADIUS, RADIUS + 1):
        y = F.col(f"__n{s + RADIUS}")
        dy = y - F.col("y")
        cands.append(F.when(y.isNotNull(), F.struct((dy * dy + s * s).cast("long").alias("d"), y.cast("long").alias("oy"), (F.col("x") + s).cast("long").alias("ox"))))
    best = F.array_min(F.array_compact(F.array(*cands)))
    d = d.withColumn("__b", best).withColumns({"ox": F.col("__b.ox"), "oy": F.col("__b.oy")})
    return d.drop("__u", "__v", "__c", "__b", *near)


def recolor_shell(px: DataFrame, source: DataFrame, before: DataFrame, facts: DataFrame) -> DataFrame:
    """``px`` with grey shell pixels in the outline's colour; ``shell`` marks them.

    ``facts`` (columns of ``FACTS``) names the outline colour, the part of the source that was used
    and the offset of the final raster against both earlier ones. Evidence is taken at the same place.
    """
    keep = px.columns
    mean = px.where(F.col("a") >= ALPHA).groupBy("asset_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = nearest_outline(px.join(facts, "asset_id").withColumn("on", outline_like())).join(mean, "asset_id", "left")
    cx, cy = F.coalesce("cx", F.col("w") / 2), F.coalesce("cy", F.col("h") / 2)
    sq = lambda v: v * v
    mine, theirs = sq(F.col("x") - cx) + sq(F.col("y") - cy), sq(F.col("ox") - cx) + sq(F.col("oy") - cy)
    dot = (F.col("x") - F.col("ox")) * (F.col("ox") - cx) + (F.col("y") - F.col("oy")) * (F.col("oy") - cy)
    outer = (F.round(mine - theirs, 9) >= -1) & (F.round(dot, 9) >= -0.5)
    d = d.withColumn("cand", shell() & F.col("ox").isNotNull() & outer)
    d = d.withColumns({"bx": F.col("x") - F.col("offset_x"), "by": F.col("y") - F.col("offset_y"), "sx": F.col("rect_x") + F.col("x") - F.col("offset_x"), "sy": F.col("rect_y") + F.col("y") - F.col("offset_y")})
    raw = evidence(source, facts, True, True).select("asset_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.lit(True).alias("raw"))
    pre = evidence(before, facts, False, False).select("asset_id", F.col("x").alias("bx"), F.col("y").alias("by"), F.lit(True).alias("pre"))
    d = d.join(raw, ["asset_id", "sx", "sy"], "left").join(pre, ["asset_id", "bx", "by"], "left")
    d = d.withColumn("shell", F.col("cand") & (F.coalesce("raw", F.lit(False)) | F.coalesce("pre", F.lit(False))))
    new = dict(zip("rgb", C.rgb(F.col("outline"))))
    return d.select(*[F.when(F.col("shell"), new[c]).otherwise(F.col(c)).cast("long").alias(c) if c in new else F.col(c) for c in keep], "shell")
