"""Size, fit and layout arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.color import rnd

# Allowed palette budgets.
PALETTE_BUDGETS = (8, 16, 24, 32, 64, 128, 256, 512)
DEFAULT_FRAME_MS = 120


def one() -> Column:
    return F.lit(1).cast("long")


def rgba_bytes(w: Column, h: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), w) * F.greatest(F.lit(0).cast("long"), h) * 4


def aspect_height(value: Column, source_w: Column, source_h: Column) -> Column:
    return F.greatest(one(), rnd(value / (source_w / source_h)))


def nearest_budget(value: Column) -> Column:
    """Closest allowed budget; the smaller one wins ties."""
    return F.array_min(F.array(*[F.struct(F.abs(value - b).alias("d"), F.lit(b).cast("long").alias("b")) for b in PALETTE_BUDGETS]))["b"]


def fit_count(sheet: Column, frame: Column, margin: Column, spacing: Column) -> Column:
    """Frames that fit along one side of a sheet (at least one)."""
    room = F.greatest(F.lit(0).cast("long"), sheet - margin * 2 + spacing)
    return F.greatest(one(), F.floor(room / F.greatest(one(), frame + spacing)))


def used_size(count: Column, frame: Column, margin: Column, spacing: Column) -> Column:
    return margin * 2 + count * frame + F.greatest(F.lit(0).cast("long"), count - 1) * spacing


def slice_frames(sheets: DataFrame) -> DataFrame:
    """Grid cells of ``sheets(asset_id, rows, cols, frame_w, frame_h, margin, spacing)`` as frames."""
    seq = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    d = sheets.withColumn("row", F.explode(seq("rows"))).withColumn("col", F.explode(seq("cols")))
    idx = F.col("row") * F.col("cols") + F.col("col")
    return d.select(
        "asset_id", idx.alias("frame_idx"), F.format_string("frame_%03d", idx).alias("name"),
        (F.col("margin") + F.col("col") * (F.col("frame_w") + F.col("spacing"))).alias("x"),
        (F.col("margin") + F.col("row") * (F.col("frame_h") + F.col("spacing"))).alias("y"),
        F.col("frame_w").alias("w"), F.col("frame_h").alias("h"), F.floor(F.col("frame_w") / 2).alias("pivot_x"),
        F.col("frame_h").alias("pivot_y"), F.lit(DEFAULT_FRAME_MS).cast("long").alias("duration_ms"))


def tile_repeat(frames: DataFrame, repeats: int) -> DataFrame:
    """n x n repeat cells of each frame."""
    seq = F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))
    return frames.withColumn("row", F.explode(seq)).withColumn("col", F.explode(seq)).select(
        "asset_id", "frame_idx", "row", "col", (F.col("col") * F.col("w")).alias("x"), (F.col("row") * F.col("h")).alias("y"), "w", "h")


def seam_guides(frames: DataFrame, repeats: int) -> DataFrame:
    seq = F.sequence(F.lit(1).cast("long"), F.lit(repeats - 1).cast("long"))
    lines = F.array(F.struct(F.lit("x").alias("axis"), F.col("w").alias("step")), F.struct(F.lit("y").alias("axis"), F.col("h").alias("step")))
    return frames.withColumn("line", F.explode(lines)).withColumn("i", F.explode(seq)).select(
        "asset_id", "frame_idx", "line.axis", (F.col("line.step") * F.col("i")).alias("position"))


def source_rects(frames: DataFrame, scale: Column, phase: Column, w: Column, h: Column) -> DataFrame:
    """Frame rectangles scaled to source pixels and clamped to the source image."""
    x = F.greatest(F.lit(0), F.least(w - 1, rnd(phase + F.col("x") * scale)))
    y = F.greatest(F.lit(0), F.least(h - 1, rnd(phase + F.col("y") * scale)))
    d = frames.withColumn("sx", x.cast("long")).withColumn("sy", y.cast("long"))
    size = lambda c, limit, at: F.greatest(one(), F.least(limit - F.col(at), rnd(F.col(c) * scale)))
    return d.withColumn("sw", size("w", w, "sx")).withColumn("sh", size("h", h, "sy"))


def contained_rect(box_w: Column, box_h: Column, w: Column, h: Column) -> dict[str, Column]:
    """Centred draw rectangle; whole-number zoom above 1x."""
    raw = F.least(box_w / w, box_h / h)
    s = F.when(raw >= 1, F.greatest(F.lit(1.0), F.floor(raw).cast("double"))).otherwise(raw)
    dw, dh = F.greatest(one(), F.floor(w * s)), F.greatest(one(), F.floor(h * s))
    return {"draw_x": F.floor((box_w - dw) / 2), "draw_y": F.floor((box_h - dh) / 2), "draw_w": dw, "draw_h": dh}


def uniform_boundaries(start: Column, scale: Column, size: Column) -> Column:
    """Rounded lattice lines from ``start`` every ``scale``, clamped to the image."""
    n = F.greatest(one(), F.floor((size - start) / scale))
    return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.greatest(F.lit(0), F.least(size, rnd(start + i * scale))).cast("long"))
