"""Frames, clips and sheets: lookups, overrides, packing, stability and validation.

Frame tables: ``asset_id, frame_idx, name, w, h, pivot_x, pivot_y, duration_ms`` and, on a
sheet, ``x, y``.  Clip tables: ``asset_id, name, frames ARRAY<STRING>, fps, loop, direction``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ordering import running_sum

TOLERANCE_PX, TOLERANCE_MS = 1.0, 0.0
TARGETS = ("godot", "unity", "phaser", "texturepacker", "tiled", "ldtk")


def frame_index(frames: DataFrame) -> DataFrame:
    """Name -> index; a repeated name keeps its last frame."""
    return frames.groupBy("asset_id", "name").agg(F.max("frame_idx").alias("frame_idx"), F.max_by("duration_ms", "frame_idx").alias("duration_ms"))


def clip_frames(clips: DataFrame) -> DataFrame:
    return clips.select("asset_id", F.col("name").alias("clip"), F.posexplode("frames").alias("pos", "name"))


def clip_order(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """Frames of each clip in clip order; names without a frame are skipped.

    Clips hold arrays, which unfold to many times what Spark takes their files for, so this and
    the joins on its groups are merges, never broadcasts.
    """
    return clip_frames(clips).join(frame_index(frames).hint("merge"), ["asset_id", "name"]).select(
        "asset_id", "clip", F.col("pos").cast("long").alias("pos"), "name", "frame_idx")


def dangling(frames: DataFrame, clips: DataFrame) -> DataFrame:
    names = frames.select("asset_id", "name").distinct()
    return clip_frames(clips).join(names, ["asset_id", "name"], "left_anti").select("asset_id", "clip", F.col("pos").cast("long").alias("pos"), "name")


def clip_range(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """First and last frame index of each clip, -1 when it has none."""
    have = clip_order(frames, clips).groupBy("asset_id", "clip").agg(
        F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi"), F.count(F.lit(1)).alias("n"))
    base = clips.select("asset_id", F.col("name").alias("clip"))
    return base.join(have.hint("merge"), ["asset_id", "clip"], "left").select(
        "asset_id", "clip", F.coalesce("lo", F.lit(-1)).alias("start_index"), F.coalesce("hi", F.lit(-1)).alias("end_index"), F.coalesce("n", F.lit(0)).alias("n"))


def layer_overrides(frames: DataFrame, clips: DataFrame, by_frame: DataFrame, by_clip: DataFrame) -> DataFrame:
    """Frame override > clip override > frame value, for pivot and duration.

    ``by_frame(asset_id, name, pivot_x, pivot_y, duration_ms)`` and ``by_clip(asset_id, clip, ...)``.
    """
    owner = clip_frames(clips).groupBy("asset_id", "name").agg(F.max("clip").alias("clip"))
    f = by_frame.select("asset_id", "name", *[F.col(c).alias(f"f_{c}") for c in ("pivot_x", "pivot_y", "duration_ms")])
    c = by_clip.select("asset_id", "clip", *[F.col(k).alias(f"c_{k}") for k in ("pivot_x", "pivot_y", "duration_ms")])
    j = frames.join(owner, ["asset_id", "name"], "left").join(f, ["asset_id", "name"], "left").join(c, ["asset_id", "clip"], "left")
    ms = F.coalesce("f_duration_ms", "c_duration_ms")
    clamp = F.greatest(F.lit(1), F.least(F.lit(60000), ms)).cast("long")
    return j.select("asset_id", "frame_idx", "name", F.coalesce("f_pivot_x", "c_pivot_x", "pivot_x").alias("pivot_x"),
                    F.coalesce("f_pivot_y", "c_pivot_y", "pivot_y").alias("pivot_y"), F.when(ms.isNotNull(), clamp).otherwise(F.col("duration_ms")).alias("duration_ms"))


def missing_exports(frames: DataFrame, exported: DataFrame) -> DataFrame:
    return frames.join(exported.select("asset_id", "name").distinct(), ["asset_id", "name"], "left_anti").select("asset_id", "frame_idx", "name")


_METRICS = {"baseline": ("pivot_y",), "pivot": ("pivot_x", "pivot_y"), "frame_size": ("w", "h"), "content_center": ("cx", "cy"), "duration": ("duration_ms",)}


def stability_deltas(frames: DataFrame) -> DataFrame:
    """Distance of each frame from the per-asset median of five metrics.

    ``percentile`` keeps a value -> count map per asset, so a long clip costs no more memory
    than its distinct values.
    """
    d = frames.withColumn("cx", F.col("w") / 2.0).withColumn("cy", F.col("h") / 2.0)
    cols = sorted({c for v in _METRICS.values() for c in v})
    med = d.groupBy("asset_id").agg(*[F.percentile(c, F.lit(0.5)).alias(f"m_{c}") for c in cols])
    j = d.join(med, "asset_id")
    gap = lambda c: F.abs(F.col(c) - F.col(f"m_{c}"))
    delta = lambda cs: gap(cs[0]).cast("double") if len(cs) == 1 else F.greatest(*[gap(c) for c in cs])
    return j.select("asset_id", "frame_idx", "name", *[delta(cs).alias(k) for k, cs in _METRICS.items()])


def stability_issues(deltas: DataFrame) -> DataFrame:
    """(asset, code) rows with affected frame counts and the largest delta."""
    spec = [("baseline-drift", "warning", "baseline", "px", TOLERANCE_PX), ("pivot-drift", "warning", "pivot", "px", TOLERANCE_PX),
            ("frame-size-variance", "info", "frame_size", "px", TOLERANCE_PX), ("content-center-drift", "warning", "content_center", "px", TOLERANCE_PX),
            ("duration-variance", "info", "duration", "ms", TOLERANCE_MS)]
    rows = F.array_compact(F.array(*[
        F.when(F.col(k) > tol, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(unit).alias("unit"), F.col(k).alias("delta")))
        for code, sev, k, unit, tol in spec]))
    d = deltas.withColumn("i", F.explode(rows))
    return d.groupBy("asset_id", "i.code", "i.severity", "i.unit").agg(F.count(F.lit(1)).alias("affected"), F.max("i.delta").alias("max_delta"))


def stability_summary(deltas: DataFrame) -> DataFrame:
    bad = (F.col("duration") > TOLERANCE_MS) | F.greatest("baseline", "pivot", "frame_size", "content_center").__gt__(TOLERANCE_PX)
    return deltas.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(~bad).alias("stable"), *[F.max(k).alias(f"max_{k}") for k in _METRICS])


def pack_normalised(frames: DataFrame, columns: int, margin: int, spacing: int) -> DataFrame:
    """Common cell from the largest pivot extents; row-major target rectangles and offsets."""
    m = frames.groupBy("asset_id").agg(
        F.max("pivot_x").alias("left"), F.max("pivot_y").alias("top"), F.max(F.col("w") - F.col("pivot_x")).alias("right"),
        F.max(F.col("h") - F.col("pivot_y")).alias("bottom"), F.count(F.lit(1)).alias("n"))
    j = frames.join(m, "asset_id")
    cell_w, cell_h = F.greatest(F.lit(1.0), F.col("left") + F.col("right")), F.greatest(F.lit(1.0), F.col("top") + F.col("bottom"))
    cols = F.greatest(F.lit(1), F.least(F.col("n"), F.lit(columns)))
    at = lambda pos, size: (F.lit(margin) + pos * (size + spacing)).cast("long")
    return j.select("asset_id", "frame_idx", "name", at(F.col("frame_idx") % cols, cell_w).alias("x"), at(F.floor(F.col("frame_idx") / cols), cell_h).alias("y"),
                    cell_w.cast("long").alias("w"), cell_h.cast("long").alias("h"), (F.col("left") - F.col("pivot_x")).cast("long").alias("dx"),
                    (F.col("top") - F.col("pivot_y")).cast("long").alias("dy"))


def onion_skin(frames: DataFrame, wrap: bool) -> DataFrame:
    """Previous and next frame by dense index; two equi-joins, no per-asset window."""
    n = frames.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    d = frames.select("asset_id", "frame_idx", "name").join(n, "asset_id")
    def neighbour(step: int, label: str) -> DataFrame:
        to = F.col("frame_idx") - step
        if wrap:
            to = F.pmod(to, F.col("n"))
        side = d.filter("n > 1").withColumn("at", to).filter((F.col("at") >= 0) & (F.col("at") < F.col("n")))
        return side.select("asset_id", F.col("at").alias("frame_idx"), F.col("name").alias(label))

    return d.join(neighbour(-1, "previous"), ["asset_id", "frame_idx"], "left").join(neighbour(1, "next"), ["asset_id", "frame_idx"], "left").drop("n")


def pack_rows(frames: DataFrame, margin: int, spacing: int) -> DataFrame:
    """Running x inside each sheet row and running y over the rows (``row``, ``col`` given)."""
    d = running_sum(frames, ["asset_id", "row"], "col", F.col("w") + spacing, "end_x")
    rows = frames.groupBy("asset_id", "row").agg(F.max("h").alias("row_h"))
    rows = running_sum(rows, ["asset_id"], "row", F.col("row_h") + spacing, "end_y")
    return d.join(rows, ["asset_id", "row"]).select(
        "asset_id", "row", "col", "name", (F.col("end_x") - F.col("w") - spacing + margin).alias("x"),
        (F.col("end_y") - F.col("row_h") - spacing + margin).alias("y"), "w", "h")


def sparse_rows(rows: DataFrame) -> DataFrame:
    """Rows with fewer frames than the widest row of their asset."""
    top = rows.groupBy("asset_id").agg(F.max("frame_count").alias("target"))
    return rows.join(top, "asset_id").filter((F.col("frame_count") > 0) & (F.col("frame_count") < F.col("target"))).select(
        "asset_id", "row", "frame_count", "target", (F.col("target") - F.col("frame_count")).alias("missing"))


def manifest_animations(frames: DataFrame, clips: DataFrame, fps: int = 8, direction: str = "forward") -> DataFrame:
    """Clip settings with fallbacks; frame durations only when every frame exists."""
    want = clip_frames(clips).join(frame_index(frames), ["asset_id", "name"], "left")
    g = want.groupBy("asset_id", "clip").agg(
        F.count(F.lit(1)).alias("n"), F.count("duration_ms").alias("have"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "duration_ms"))), lambda e: e["duration_ms"]).alias("ms"))
    j = clips.withColumnRenamed("name", "clip").join(g, ["asset_id", "clip"])
    return j.select("asset_id", "clip", F.coalesce("fps", F.lit(fps)).alias("fps"), F.coalesce("loop", F.lit(True)).alias("loop"),
                    F.coalesce("direction", F.lit(direction)).alias("direction"), "n",
                    F.when(F.col("n") == F.col("have"), F.concat_ws(",", F.transform("ms", lambda v: v.cast("string")))).alias("durations"))


def validate_manifest(frames: DataFrame, clips: DataFrame, sheets: DataFrame) -> DataFrame:
    """Problem rows of a manifest: duplicate names, bounds, dangling frames, empty palette.

    ``frames`` carries x, y; ``sheets(asset_id, sheet_w, sheet_h, colors)``.
    """
    row = lambda df, code, detail: df.select("asset_id", F.lit(code).alias("code"), detail.alias("detail"))
    dup = frames.groupBy("asset_id", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dup = dup.withColumn("i", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"))))
    f = frames.join(sheets, "asset_id")
    out = f.filter((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("sheet_w")) | (F.col("y") + F.col("h") > F.col("sheet_h")))
    return (
        row(dup, "duplicate-frame", F.col("name")).unionByName(row(out, "frame-bounds", F.col("name")))
        .unionByName(row(dangling(frames, clips), "missing-frame", F.concat_ws("/", "clip", "name")))
        .unionByName(row(sheets.filter("colors = 0"), "empty-palette", F.lit(""))))


def validate_boxes(frames: DataFrame, boxes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Boxes and anchors that leave their frame."""
    size = frames.select("asset_id", "frame_idx", F.col("w").alias("fw"), F.col("h").alias("fh"))
    b = boxes.join(size, ["asset_id", "frame_idx"]).filter(
        (F.col("x") < 0) | (F.col("y") < 0) | (F.col("w") < 1) | (F.col("h") < 1) | (F.col("x") + F.col("w") > F.col("fw")) | (F.col("y") + F.col("h") > F.col("fh")))
    a = anchors.join(size, ["asset_id", "frame_idx"]).filter(
        (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") > F.col("fw")) | (F.col("y") > F.col("fh")))
    pick = lambda df, code: df.select("asset_id", "frame_idx", F.lit(code).alias("code"), "name")
    return pick(b, "box-bounds").unionByName(pick(a, "anchor-bounds"))


def engine_warnings(sheets: DataFrame, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """Common warnings per target.  ``sheets(asset_id, extrude, source_rects, boxes, asset_type)``."""
    codes = F.array_compact(F.array(
        F.when(F.col("extrude") > 0, F.struct(F.lit("extrude-logical-rects").alias("c"), F.lit("info").alias("s"))),
        F.when(F.col("source_rects") > 0, F.struct(F.lit("source-rect-generic-only").alias("c"), F.lit("info").alias("s"))),
        F.when(F.col("boxes") > 0, F.struct(F.lit("gameplay-metadata-generic-only").alias("c"), F.lit("info").alias("s"))),
        F.when(F.col("asset_type") == "tilemap", F.struct(F.lit("tilemap-inspect-only").alias("c"), F.lit("warning").alias("s")))))
    d = sheets.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets]))).withColumn("e", F.explode(codes))
    return d.select("asset_id", "target", F.concat(F.lit("engine-"), F.col("target"), F.lit("-"), F.col("e.c")).alias("code"), F.col("e.s").alias("severity"))


def validation_summary(issues: DataFrame, counts: DataFrame) -> DataFrame:
    """Error and warning totals per asset beside its frame, clip, colour and file counts."""
    n = issues.groupBy("asset_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    j = counts.join(n, "asset_id", "left").na.fill(0, ["errors", "warnings"])
    return j.withColumn("ok", F.col("errors") == 0)


def frames_at(px: DataFrame, frames: DataFrame, inclusive: bool = False, bucket: int = 64) -> DataFrame:
    """Pixels inside frame rectangles (``frame_idx`` added; a pixel may lie in several frames).

    Rectangles are listed in every ``bucket`` x ``bucket`` tile they cover, which turns the
    range join into an equi-join on (asset, tile) plus an exact filter.
    """
    far = 0 if inclusive else 1
    tiles = lambda lo, ext: F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(lo) + F.col(ext) - far) / bucket))
    f = frames.withColumn("bx", F.explode(tiles("x", "w"))).withColumn("by", F.explode(tiles("y", "h"))).select(
        "asset_id", "frame_idx", "bx", "by", *[F.col(c).alias(f"f{c}") for c in "xywh"])
    p = px.withColumn("bx", F.floor(F.col("x") / bucket)).withColumn("by", F.floor(F.col("y") / bucket))
    j = p.join(f, ["asset_id", "bx", "by"])
    end = lambda p_, o, e: (F.col(p_) <= F.col(o) + F.col(e)) if inclusive else (F.col(p_) < F.col(o) + F.col(e))
    return j.filter((F.col("x") >= F.col("fx")) & (F.col("y") >= F.col("fy")) & end("x", "fx", "fw") & end("y", "fy", "fh")).drop("bx", "by")


def topmost_frame(px: DataFrame, frames: DataFrame) -> DataFrame:
    """Last frame whose closed rectangle holds the pixel."""
    return frames_at(px, frames, inclusive=True).groupBy("asset_id", "idx").agg(F.max("frame_idx").alias("frame_idx"))


def crop_frames(px: DataFrame, frames: DataFrame) -> DataFrame:
    """Pixels of each frame in frame-local coordinates."""
    j = frames_at(px, frames)
    lx, ly = F.col("x") - F.col("fx"), F.col("y") - F.col("fy")
    return j.select("asset_id", "frame_idx", (ly * F.col("fw") + lx).alias("idx"), lx.alias("x"), ly.alias("y"), F.col("fw").alias("w"), F.col("fh").alias("h"), "r", "g", "b", "a")


def scale_nearest(px: DataFrame, width: int, height: int) -> DataFrame:
    """Nearest-neighbour resize: source ``floor(x * w / width)``.

    Each source pixel lists the target pixels that read it, so no join is needed.
    """
    def targets(p: str, size: str, out: int) -> Column:
        lo = F.ceil(F.col(p) * out / F.col(size))
        hi = F.ceil((F.col(p) + 1) * out / F.col(size)) - 1
        return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    d = px.withColumn("tx", F.explode(targets("x", "w", width))).withColumn("ty", F.explode(targets("y", "h", height)))
    return d.select("asset_id", (F.col("ty") * width + F.col("tx")).alias("idx"), F.col("tx").alias("x"), F.col("ty").alias("y"),
                    F.lit(width).cast("long").alias("w"), F.lit(height).cast("long").alias("h"), "r", "g", "b", "a")


def palette_drift(px: DataFrame, frames: DataFrame, active: DataFrame, budget: int) -> DataFrame:
    """How far per-frame palettes leave the active palette: delta, variance, pressure, stability."""
    from gridloom.functions import color as C
    from gridloom.operators.histogram import frequency_palette, histogram

    hist = histogram(frames_at(px, frames), keys=("asset_id", "frame_idx"))
    exact = hist.groupBy("asset_id", "frame_idx").agg(F.count(F.lit(1)).alias("exact"))
    pal = frequency_palette(hist, budget, keys=("asset_id", "frame_idx")).select("asset_id", "frame_idx", C.five_bit(F.col("color")).alias("c")).distinct()
    act = active.select("asset_id", C.five_bit(F.col("color")).alias("c")).distinct().withColumn("known", F.lit(1))
    per = pal.join(act, ["asset_id", "c"], "left").groupBy("asset_id", "frame_idx").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(F.col("known").isNull()).alias("delta")).join(exact, ["asset_id", "frame_idx"])
    g = per.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("frames"), F.max("exact").alias("max_colors"), F.max("delta").alias("max_delta"), F.avg("delta").alias("avg_delta"),
        F.min("size").alias("lo"), F.max("size").alias("hi"))
    b = F.lit(float(budget))
    var = F.when(F.col("frames") > 1, (F.col("hi") - F.col("lo")) / b).otherwise(F.lit(0.0))
    press = F.greatest(F.col("max_delta") / b, F.greatest(F.lit(0), F.col("max_colors") - budget) / F.greatest(F.lit(1), F.col("max_colors")))
    r2 = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 100.0 + 0.5) / 100.0
    stab = r2(F.round(F.lit(1.0) - F.least(F.lit(1.0), press * 0.72 + var * 0.2 + F.col("avg_delta") / b * 0.08), 9))
    label = F.when(stab >= 0.82, "stable").when(stab >= 0.62, "review").otherwise("unstable")
    return g.select("asset_id", "frames", "max_colors", "max_delta", (F.floor(F.col("avg_delta") * 100.0 + 0.5) / 100.0).alias("avg_delta"),
                    r2(var).alias("variance"), r2(press).alias("pressure"), stab.alias("stability"), label.alias("label"))
