"""Is there one object before a backdrop: foreground share, bounds and edge contact against a border gradient.

The backdrop at a pixel is blended from the two ends of its row, or of its column, whichever is
nearer. The ends are window values along the image line, so no pixel meets a border table. The
gradient is used only for images of 8 pixels and more whose border changes smoothly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.operators.alpha import corner_mean

# Fixed values of the rule.
THRESHOLD, ALPHA, LEAST_SIDE, MEAN_STEP, LARGEST_STEP = 64, 16, 8, 8, 36
SHARE, COVERAGE, TOUCH = (0.04, 0.65), (0.04, 0.78), 0.08
_CH = "rgba"


def _ends(px: DataFrame) -> DataFrame:
    whole = (W.unboundedPreceding, W.unboundedFollowing)
    row, col = W.partitionBy("asset_id", "y").orderBy("x").rowsBetween(*whole), W.partitionBy("asset_id", "x").orderBy("y").rowsBetween(*whole)
    v = F.struct(*_CH)
    return px.withColumns({"left": F.first(v).over(row), "right": F.last(v).over(row), "top": F.first(v).over(col), "bottom": F.last(v).over(col)})


def smooth_borders(px: DataFrame) -> DataFrame:
    """``asset_id`` of images whose border lines change by little from pixel to pixel."""
    row, col = W.partitionBy("asset_id", "y").orderBy("x"), W.partitionBy("asset_id", "x").orderBy("y")
    v = F.struct(*_CH)
    step = lambda prev: sum((F.abs(F.col(c) - F.col(f"{prev}.{c}")) for c in "gba"), F.abs(F.col("r") - F.col(f"{prev}.r")))
    flat = px.where((F.col("y") == 0) | (F.col("y") == F.col("h") - 1)).withColumn("p", F.lag(v).over(row)).where("p IS NOT NULL")
    tall = px.where((F.col("x") == 0) | (F.col("x") == F.col("w") - 1)).withColumn("p", F.lag(v).over(col)).where("p IS NOT NULL")
    # An image of one line or column has it as both of its borders.
    both = lambda size: F.when(F.col(size) == 1, 2).otherwise(1)
    d = flat.select("asset_id", "w", "h", step("p").alias("d"), both("h").alias("t")).unionByName(tall.select("asset_id", "w", "h", step("p").alias("d"), both("w").alias("t")))
    g = d.groupBy("asset_id").agg((F.sum(F.col("d") * F.col("t")) / F.sum("t")).alias("mean"), F.max("d").alias("most"), F.min(F.least("w", "h")).alias("side"))
    return g.where((F.col("mean") <= MEAN_STEP) & (F.col("most") <= LARGEST_STEP) & (F.col("side") >= LEAST_SIDE)).select("asset_id")


def foreground_evidence(px: DataFrame, step: int = 1) -> DataFrame:
    """``asset_id, gradient, foreground, coverage, touch, single``; ``step`` > 1 looks at every ``step``-th pixel of both directions."""
    smooth = smooth_borders(px).withColumn("gradient", F.lit(True))
    size = F.greatest(F.lit(2), F.least(F.lit(12), F.floor(F.least("w", "h") / 48)))
    facts = corner_mean(px, size).join(smooth, "asset_id", "left").withColumn("gradient", F.coalesce("gradient", F.lit(False)))
    d = _ends(px)
    if step > 1:
        d = d.where((F.col("x") % step == 0) & (F.col("y") % step == 0))
    d = d.join(facts, "asset_id")

    def blend(a: str, b: str, at: Column) -> Column:
        parts = [F.abs(F.col(c) - (F.col(f"{a}.{c}") + (F.col(f"{b}.{c}") - F.col(f"{a}.{c}")) * at)) for c in _CH]
        return F.round(sum(parts[1:], parts[0]), 9)

    along = blend("left", "right", F.col("x") / F.greatest(F.lit(1), F.col("w") - 1))
    down = blend("top", "bottom", F.col("y") / F.greatest(F.lit(1), F.col("h") - 1))
    flat = F.round(C.l1(tuple(F.col(c) for c in _CH), tuple(F.col(f"bg_{c}") for c in _CH)), 9)
    far = F.least(flat, F.when(F.col("gradient"), F.least(along, down)))
    on = (F.col("a") > ALPHA) & ((F.col("bg_a") <= ALPHA) | (far > THRESHOLD))
    edge = (F.col("x") <= step) | (F.col("y") <= step) | (F.col("x") >= F.col("w") - step * 2) | (F.col("y") >= F.col("h") - step * 2)
    at = lambda c: F.when(on, F.col(c))
    g = d.groupBy("asset_id").agg(
        F.max("gradient").alias("gradient"), F.count(F.lit(1)).alias("total"), F.count_if(on).alias("n"), F.count_if(on & edge).alias("t"), F.max(F.col("w") * F.col("h")).alias("area"),
        *[f(at(c)).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))])
    six = lambda v: F.round(v, 6)
    box = F.coalesce((F.col("x1") - F.col("x0") + step) * (F.col("y1") - F.col("y0") + step), F.lit(0))
    g = g.select("asset_id", "gradient", six(F.col("n") / F.col("total")).alias("foreground"), six(box / F.col("area")).alias("coverage"), six(F.col("t") / F.greatest(F.lit(1), F.col("n"))).alias("touch"))
    return g.withColumn("single", F.col("foreground").between(*SHARE) & F.col("coverage").between(*COVERAGE) & (F.col("touch") <= TOUCH))
