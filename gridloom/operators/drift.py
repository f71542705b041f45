"""Local drift of a grid: each cell boundary moves to a stronger edge nearby, smoothly along its line.

Boundary scores are sums of pixel differences over one cell's length, a grouped aggregate keyed by
(asset, axis, line, boundary, offset) that is reduced before it is shuffled. The choice along a line
depends on the boundary before it, so a line's boundaries (a few numbers each) are folded in order
inside one row; all assets, axes and lines are folded at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.stencil import column_window, row_window

# Fixed values of the rule; penalties count in hundredths, so that choices are made on integers.
MAX_OFFSET, STEP_PENALTY, MIN_IMPROVEMENT, MOVE_BONUS = 3, 12, 0.08, 0.03
GRID = "asset_id long, scale long, phase_x long, phase_y long, out_w long, out_h long"
LINE = ["asset_id", "axis", "line"]


def _radius() -> Column:
    return F.least(F.lit(MAX_OFFSET), F.floor(F.col("scale") / 2))


def boundary_scores(px: DataFrame, grid: DataFrame) -> DataFrame:
    """``asset_id, axis, line, i, offset, score``: differences across each inner boundary of each cell line, at every offset within reach.

    Axis x: boundaries between columns, one line per cell row; axis y the other way round.
    """
    v = F.struct("r", "g", "b", "a")
    delta = lambda prev: sum((F.abs(F.col(c) - F.col(f"{prev}.{c}")) for c in "gba"), F.abs(F.col("r") - F.col(f"{prev}.r")))
    d = px.select("asset_id", "x", "y", "r", "g", "b", "a").withColumn("v", v)
    d = d.withColumns({"left": F.lag("v").over(row_window()), "up": F.lag("v").over(column_window())}).join(grid, "asset_id")

    def one(axis: str, prev: str, pos: str, other: str, phase: str, cross: str, n: str, m: str) -> DataFrame:
        cell = F.floor((F.col(pos) - F.col(phase)) / F.col("scale"))
        near = d.where(F.col(prev).isNotNull()).withColumn("i", F.explode(F.array(cell, cell + 1))).withColumn("offset", F.col(pos) - F.col(phase) - F.col("i") * F.col("scale"))
        near = near.withColumn("line", F.floor((F.col(other) - F.col(cross)) / F.col("scale")))
        near = near.where((F.col("i") >= 1) & (F.col("i") < F.col(n)) & (F.abs(F.col("offset")) <= _radius()) & (F.col("line") >= 0) & (F.col("line") < F.col(m)))
        return near.groupBy("asset_id", F.lit(axis).alias("axis"), F.col("line").cast("long").alias("line"), F.col("i").cast("long").alias("i"), "offset").agg(F.sum(delta(prev)).alias("score"))

    return one("x", "left", "x", "y", "phase_x", "phase_y", "out_w", "out_h").unionByName(one("y", "up", "y", "x", "phase_y", "phase_x", "out_h", "out_w"))


def plan_boundaries(px: DataFrame, grid: DataFrame) -> DataFrame:
    """``asset_id, axis, line, i, offset, nominal, corrected``: the chosen offset of each inner boundary and the scores at its old and new place."""
    scores = boundary_scores(px, grid)
    facts = grid.select("asset_id", "scale")
    each = scores.groupBy(*LINE, "i").agg(F.array_sort(F.collect_list(F.struct("offset", "score"))).alias("at"))  # at most seven offsets
    rows = each.join(facts, "asset_id").groupBy(*LINE, "scale").agg(F.array_sort(F.collect_list(F.struct("i", "at"))).alias("seq"))
    scale, radius = F.col("scale"), _radius()
    out_type = "array<struct<i:bigint,offset:bigint,nominal:bigint,corrected:bigint>>"

    def step(acc: Column, b: Column) -> Column:
        at = b["at"]
        score = lambda off: F.get(at, (off + radius).cast("int"))["score"]
        still = score(F.lit(0)) * 100
        # Ties of the adjusted score go to the smallest offset, the first one tried.
        ranked = F.transform(at, lambda p: F.struct((p["score"] * 100 - F.abs(p["offset"] - acc["offset"]) * STEP_PENALTY).alias("adj"), (-p["offset"]).alias("neg")))
        inside = F.filter(ranked, lambda p: F.abs(p["neg"]) < scale)
        best = F.array_max(inside)
        wanted = F.when(best["adj"] > still, -best["neg"]).otherwise(0)
        # Boundaries of a line stay in order: one pixel after the one before (which lies at -scale + its offset).
        offset = F.least(F.greatest(wanted, acc["offset"] - scale + 1), scale - 1).cast("bigint")
        row = F.struct(b["i"].alias("i"), offset.alias("offset"), score(F.lit(0)).alias("nominal"), score(offset).alias("corrected"))
        return F.struct(offset.alias("offset"), F.array_append(acc["out"], row).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("offset"), F.array().cast(out_type).alias("out"))
    return rows.select(*LINE, F.explode(F.aggregate("seq", start, step)["out"]).alias("b")).select(*LINE, "b.*")


def drift_report(plan: DataFrame, grid: DataFrame) -> DataFrame:
    """One row per asset: whether the correction is worth using, its gain, unevenness and sizes."""
    from pyspark.sql import Window as W

    d = plan.join(grid.select("asset_id", "scale", "out_w", "out_h"), "asset_id")
    before = F.coalesce(F.lag("offset").over(W.partitionBy(*LINE).orderBy("i")), F.lit(0))
    size = F.abs("offset")
    bonus = F.when((size > 0) & (F.col("corrected") > 0), F.col("corrected") * F.lit(MOVE_BONUS) * size / F.greatest(F.lit(1), _radius())).otherwise(F.lit(0.0))
    d = d.withColumns({"jump": F.abs(F.col("offset") - before), "gain": F.col("corrected") + bonus})
    axis = d.groupBy("asset_id", "axis").agg(
        F.sum("nominal").alias("nominal"), F.sum("gain").alias("gain"), F.sum("jump").alias("jump"), F.count_if(size > 0).alias("moved"), F.sum(size).alias("total"), F.max(size).alias("most"),
        F.max("out_w").alias("ow"), F.max("out_h").alias("oh"))
    cells = F.when(F.col("axis") == "x", F.col("oh") * F.greatest(F.lit(1), F.col("ow") - 1)).otherwise(F.col("ow") * F.greatest(F.lit(1), F.col("oh") - 1))
    g = axis.withColumn("rough", F.col("jump") * F.lit(STEP_PENALTY / 100) / F.greatest(F.lit(1), cells)).groupBy("asset_id").agg(
        *[F.sum(c).alias(c) for c in ("nominal", "gain", "moved", "total", "rough")], F.max("most").alias("most"))
    three = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(v, 9))) * 1000.0 + 0.5) / 1000.0
    better = three((F.col("gain") - F.col("nominal")) / F.greatest(F.lit(1), F.col("nominal")))
    g = g.withColumns({"improvement": better, "smoothness": three(F.col("rough"))})
    used = (F.col("moved") > 0) & (F.col("improvement") >= MIN_IMPROVEMENT)
    conf = F.least(F.lit(1.0), F.col("improvement") / F.lit(MIN_IMPROVEMENT)) * (F.lit(1.0) - F.least(F.lit(0.5), F.col("smoothness")))
    when = lambda v: F.when(used, v).otherwise(0)
    mean = F.floor(F.round(F.col("total") / F.col("moved"), 9) * 100.0 + 0.5) / 100.0
    return g.select("asset_id", used.alias("used"), F.when(used, three(conf)).otherwise(F.lit(0.0)).alias("confidence"), "improvement", "smoothness",
                    when(F.col("moved")).alias("moved"), when(F.col("most")).alias("max_offset"), F.when(used, mean).otherwise(F.lit(0.0)).alias("mean_offset"))
