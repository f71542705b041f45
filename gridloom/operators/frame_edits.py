"""Bulk edits of frames, rows, clips and frame metadata.

Edits are tables joined to their targets, so thousands of sheets change in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.color import rnd
from gridloom.operators.ordering import rank_in_chunks


def clamp(v: Column, lo: Column | int, hi: Column | int) -> Column:
    as_col = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.greatest(as_col(lo), F.least(as_col(hi), rnd(v)))


def set_row_counts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows(asset_id, row, col, name)``: cut rows to ``targets(asset_id, row, target)`` or fill them
    with clones of their last frame."""
    n = rows.groupBy("asset_id", "row").agg(F.count(F.lit(1)).alias("n"), F.max_by("name", "col").alias("last"))
    plan = n.join(targets, ["asset_id", "row"]).withColumn("target", F.greatest(F.lit(1), F.col("target")))
    kept = rows.join(plan.select("asset_id", "row", "target"), ["asset_id", "row"], "left").filter(F.col("target").isNull() | (F.col("col") < F.col("target")))
    more = plan.filter("n < target").withColumn("col", F.explode(F.sequence(F.col("n"), F.col("target") - 1)))
    name = F.format_string("row_%d_%03d", F.col("row") + 1, F.col("col"))
    return kept.select("asset_id", "row", "col", "name", F.lit(False).alias("inserted"), F.lit("").alias("template")).unionByName(
        more.select("asset_id", "row", "col", name.alias("name"), F.lit(True).alias("inserted"), F.col("last").alias("template")))


def fill_sparse_rows(rows: DataFrame) -> DataFrame:
    """Fill every row to the widest row of its asset."""
    n = rows.groupBy("asset_id", "row").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("asset_id").agg(F.max("n").alias("target"))
    return set_row_counts(rows, n.join(top, "asset_id").select("asset_id", "row", "target"))


def edit_rows(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """One row edit per asset: ``edits(asset_id, op, at)`` with op insert_before, insert_after or remove.

    An inserted row holds one clone of the first frame of the selected row; the last row of a
    sheet is never removed.
    """
    last = rows.groupBy("asset_id").agg(F.max("row").alias("last"))
    j = rows.join(edits.join(last, "asset_id"), "asset_id", "left")
    op, at = F.col("op"), F.col("at")
    drop = F.coalesce((op == "remove") & (F.col("row") == at) & (F.col("last") > 0), F.lit(False))
    slot = at + F.when(op == "insert_after", 1).otherwise(0)
    shift = F.when(op.startswith("insert") & (F.col("row") >= slot), 1).when((op == "remove") & (F.col("row") > at) & (F.col("last") > 0), -1).otherwise(0)
    moved = j.filter(~drop).select("asset_id", (F.col("row") + shift).alias("row"), "col", "name")
    new = j.filter(op.startswith("insert") & (F.col("row") == at) & (F.col("col") == 0)).select(
        "asset_id", slot.alias("row"), F.lit(0).cast("long").alias("col"), F.format_string("row_%d_000", F.col("last") + 2).alias("name"))
    return moved.unionByName(new)


def join_rows(rows: DataFrame, clips: DataFrame) -> DataFrame:
    """Concatenate the rows of ``clips(asset_id, row)`` into one clip per asset, two rows at least."""
    sel = rows.join(clips.select("asset_id", "row").distinct(), ["asset_id", "row"], "left_semi")
    many = sel.groupBy("asset_id").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).filter("lo < hi").select("asset_id")
    ranked = rank_in_chunks(sel.join(many, "asset_id", "left_semi"), ["asset_id"], ["row"], ["col"], "pos")
    return ranked.select("asset_id", (F.col("pos") - 1).alias("pos"), "name")


def resize_cells(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Cell size per (asset, row) with fallback to the widest frame of the row."""
    base = rows.groupBy("asset_id", "row").agg(F.max("w").alias("rw"), F.max("h").alias("rh"))
    j = rows.join(base, ["asset_id", "row"]).join(edits, ["asset_id", "row"], "left")
    size = lambda e, b: F.greatest(F.lit(1), F.coalesce(e, b))
    return j.select("asset_id", "row", "col", "name", size("cell_w", "rw").alias("w"), size("cell_h", "rh").alias("h"))


def scoped_patch(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """Layout patch by scope: frame beats row beats sheet.
    ``patches(asset_id, scope, row, name, spacing)``; null keys outside their scope."""
    p = {s: patches.filter(F.col("scope") == s) for s in ("sheet", "row", "frame")}
    d = rows.join(p["sheet"].select("asset_id", F.col("spacing").alias("s1")), "asset_id", "left")
    d = d.join(p["row"].select("asset_id", "row", F.col("spacing").alias("s2")), ["asset_id", "row"], "left")
    d = d.join(p["frame"].select("asset_id", "name", F.col("spacing").alias("s3")), ["asset_id", "name"], "left")
    return d.select("asset_id", "row", "col", "name", F.coalesce("s3", "s2", "s1", F.lit(0)).cast("long").alias("spacing"))


def clean_clip_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", "_"), "[^a-zA-Z0-9_-]", "")


#: Rows of one partition of a join of frames, about.
PART_ROWS = 1 << 17


def _parts(rows: DataFrame) -> int:
    """Partitions for a join of ``rows``: the usual number, and more once a task would hold too many rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))


def rename_clips(clips: DataFrame, renames: DataFrame) -> DataFrame:
    """``clips(asset_id, clip, pos, name)`` with ``renames(asset_id, clip, to)``.

    The new name is cleaned and made unique in its asset by a numeric suffix; frame names
    carrying the clip prefix follow.  An asset gets one rename per batch.
    """
    n = _parts(clips)
    taken = clips.select("asset_id", "clip").repartition(n, "asset_id").distinct()
    want = renames.withColumn("base", F.coalesce(F.nullif(clean_clip_name(F.col("to")), F.lit("")), F.col("clip")))
    other = taken.select("asset_id", F.col("clip").alias("o")).join(want, "asset_id").filter(F.col("o") != F.col("clip"))
    stem = other.filter((F.col("o") == F.col("base")) | F.col("o").startswith(F.concat("base", F.lit("_"))))
    num = F.when(F.col("o") == F.col("base"), 1).otherwise(F.expr("try_cast(substring(o, length(base) + 2) AS BIGINT)"))
    used = stem.groupBy("asset_id", "clip").agg(F.collect_set(num).alias("used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("used") + 1).cast("array<bigint>"), F.col("used")))
    by_clip = lambda df: df.repartition(n, "asset_id", "clip")
    m = by_clip(want).join(by_clip(used), ["asset_id", "clip"], "left").withColumn("n", F.when(F.col("used").isNull(), 1).otherwise(free))
    m = m.select("asset_id", "clip", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string"))).alias("new"))
    j = by_clip(clips).join(m, ["asset_id", "clip"], "left")
    pre = F.concat("clip", F.lit("_"))
    frame = F.when(F.col("name").startswith(pre), F.concat("new", F.lit("_"), F.expr("substring(name, length(clip) + 2)"))).otherwise(F.format_string("%s_%03d", "new", "pos"))
    return j.select("asset_id", F.coalesce("new", "clip").alias("clip"), "pos", F.when(F.col("new").isNotNull(), frame).otherwise(F.col("name")).alias("name"), F.col("name").alias("old_name"))


def rename_keys(overrides: DataFrame, mapping: DataFrame) -> DataFrame:
    """Follow frame renames in an override table keyed by frame name."""
    n = _parts(overrides)
    overrides = overrides.repartition(n, "asset_id", "name")
    m = mapping.select("asset_id", "old_name", F.col("name").alias("new")).repartition(n, "asset_id", "old_name").distinct()
    return overrides.join(m, (overrides["asset_id"] == m["asset_id"]) & (overrides["name"] == m["old_name"]), "left").select(
        overrides["asset_id"], F.coalesce(m["new"], overrides["name"]).alias("name"), "pivot_x", "pivot_y")


def clip_timing(clips: DataFrame, edits: DataFrame) -> DataFrame:
    j = clips.join(edits.select("asset_id", "name", F.col("fps").alias("e_fps"), F.col("loop").alias("e_loop"), F.col("direction").alias("e_dir")), ["asset_id", "name"], "left")
    fps = F.greatest(F.lit(1), F.least(F.lit(60), F.col("e_fps"))).cast("long")
    return j.select("asset_id", "name", F.when(F.col("e_fps").isNotNull(), fps).otherwise(F.col("fps")).alias("fps"), F.coalesce("e_loop", "loop").alias("loop"), F.coalesce("e_dir", "direction").alias("direction"))


def clip_from_range(frames: DataFrame, edits: DataFrame) -> DataFrame:
    """Frame names of ``edits(asset_id, clip, start_index, end_index)``, clamped and ordered."""
    n = frames.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    e = edits.join(n, "asset_id")
    at = lambda c: F.greatest(F.lit(0), F.least(F.col("n") - 1, F.col(c)))
    e = e.select("asset_id", "clip", F.least(at("start_index"), at("end_index")).alias("lo"), F.greatest(at("start_index"), at("end_index")).alias("hi"))
    return frames.join(e, "asset_id").filter(F.col("frame_idx").between(F.col("lo"), F.col("hi"))).select(
        "asset_id", "clip", (F.col("frame_idx") - F.col("lo")).alias("pos"), "name")


def move_frames(frames: DataFrame, edits: DataFrame, source: tuple[int, int], output: tuple[int, int]) -> DataFrame:
    """Move source rectangles by a delta inside the source image and follow in the output.

    ``edits(asset_id, frame_idx, dx, dy, scale)``; frames carry x, y, w, h and sx, sy, sw, sh.
    """
    j = frames.join(edits, ["asset_id", "frame_idx"])
    side = lambda s, e, d, lim: clamp(F.col(s) + F.col(d), 0, F.greatest(F.lit(0), F.lit(lim) - F.col(e)))
    j = j.withColumn("nx", side("sx", "sw", "dx", source[0])).withColumn("ny", side("sy", "sh", "dy", source[1]))
    out = lambda n, e, lim: clamp(F.col(n) / F.greatest(F.lit(0.01), F.col("scale")), 0, F.greatest(F.lit(0), F.lit(lim) - F.col(e)))
    return j.select("asset_id", "frame_idx", out("nx", "w", output[0]).alias("x"), out("ny", "h", output[1]).alias("y"), "w", "h", F.col("nx").alias("sx"), F.col("ny").alias("sy"), "sw", "sh")


def resize_frames(frames: DataFrame, edits: DataFrame, source: tuple[int, int], output: tuple[int, int], least: int = 1) -> DataFrame:
    """Drag an edge or corner (``handle`` of n, s, e, w) of the source rectangle, with clamps."""
    j = frames.join(edits, ["asset_id", "frame_idx"])
    s = F.greatest(F.lit(0.01), F.col("scale"))
    small = F.greatest(F.lit(1), rnd(F.lit(float(least)) * s))
    has = lambda c: F.col("handle").contains(c)
    right, bottom = F.col("sx") + F.col("sw"), F.col("sy") + F.col("sh")
    j = j.withColumn("l", F.when(has("w"), clamp(F.col("sx") + F.col("dx"), 0, right - small)).otherwise(F.col("sx")))
    j = j.withColumn("r", F.when(has("e"), clamp(right + F.col("dx"), F.col("l") + small, source[0])).otherwise(right))
    j = j.withColumn("t", F.when(has("n"), clamp(F.col("sy") + F.col("dy"), 0, bottom - small)).otherwise(F.col("sy")))
    j = j.withColumn("b", F.when(has("s"), clamp(bottom + F.col("dy"), F.col("t") + small, source[1])).otherwise(bottom))
    j = j.withColumn("ox", clamp(F.col("l") / s, 0, output[0] - 1)).withColumn("oy", clamp(F.col("t") / s, 0, output[1] - 1))
    j = j.withColumn("ow", clamp((F.col("r") - F.col("l")) / s, 1, output[0])).withColumn("oh", clamp((F.col("b") - F.col("t")) / s, 1, output[1]))
    fit = lambda e, o, lim: F.least(F.col(e), F.greatest(F.lit(1), F.lit(lim) - F.col(o)))
    return j.select("asset_id", "frame_idx", F.col("ox").alias("x"), F.col("oy").alias("y"), fit("ow", "ox", output[0]).alias("w"), fit("oh", "oy", output[1]).alias("h"),
                    F.col("l").alias("sx"), F.col("t").alias("sy"), (F.col("r") - F.col("l")).alias("sw"), (F.col("b") - F.col("t")).alias("sh"))


def edit_metadata(items: DataFrame, edits: DataFrame, frames: DataFrame) -> DataFrame:
    """Upsert or delete boxes by (asset, frame, id), clamped to their frame.

    ``items(asset_id, frame_idx, id, x, y, w, h)``, ``edits(..., op)`` with op set or delete.
    """
    key = ["asset_id", "frame_idx", "id"]
    e = edits.select(*key, "op", *[F.col(c).alias(f"e{c}") for c in "xywh"])
    j = items.join(e, key, "full_outer").filter(F.col("op").isNull() | (F.col("op") != "delete"))
    j = j.join(frames.select("asset_id", "frame_idx", F.col("w").alias("fw"), F.col("h").alias("fh")), ["asset_id", "frame_idx"])
    v = {c: F.coalesce(f"e{c}", c) for c in "xywh"}
    x, y = clamp(v["x"], 0, F.col("fw") - 1), clamp(v["y"], 0, F.col("fh") - 1)
    return j.select(*key, x.alias("x"), y.alias("y"), clamp(v["w"], 1, F.col("fw") - x).alias("w"), clamp(v["h"], 1, F.col("fh") - y).alias("h"))


def copy_metadata(items: DataFrame, copies: DataFrame) -> DataFrame:
    """Replace the items of target frames by those of ``copies(asset_id, source_idx, frame_idx)``."""
    src = items.withColumnRenamed("frame_idx", "source_idx").join(copies, ["asset_id", "source_idx"]).select("asset_id", "frame_idx", "id", "x", "y", "w", "h")
    hit = copies.join(items.select("asset_id", F.col("frame_idx").alias("source_idx")).distinct(), ["asset_id", "source_idx"], "left_semi").select("asset_id", "frame_idx").distinct()
    return items.join(hit, ["asset_id", "frame_idx"], "left_anti").select("asset_id", "frame_idx", "id", "x", "y", "w", "h").unionByName(src)


def default_boxes(frames: DataFrame, kinds: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    """Default box per type as fractions of the frame."""
    rows = F.array(*[F.struct(F.lit(k).alias("id"), *[F.lit(float(v)).alias(n) for v, n in zip(box, ("bx", "by", "bw", "bh"))]) for k, box in kinds.items()])
    d = frames.withColumn("b", F.explode(rows))
    return d.select("asset_id", "frame_idx", F.col("b.id").alias("id"), rnd(F.col("w") * F.col("b.bx")).alias("x"), rnd(F.col("h") * F.col("b.by")).alias("y"),
                    F.greatest(F.lit(1), rnd(F.col("w") * F.col("b.bw"))).alias("w"), F.greatest(F.lit(1), rnd(F.col("h") * F.col("b.bh"))).alias("h"))
