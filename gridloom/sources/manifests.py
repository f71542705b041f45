"""JSON sinks and sources for frames, clips and sheets.

Documents are written in pages of ``PAGE`` frames.  An ordinary asset is one page; an asset
with millions of frames becomes many bounded documents instead of one row in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.frames import clip_order, clip_range

PAGE = 512

PROJECT_SCHEMA = """frames ARRAY<STRUCT<filename: STRING, frame: STRUCT<x: BIGINT, y: BIGINT, w: BIGINT, h: BIGINT>, rotated: BOOLEAN, duration: BIGINT>>,
 meta STRUCT<frameTags: ARRAY<STRUCT<name: STRING, from: BIGINT, to: BIGINT, direction: STRING>>>"""
MANIFEST_SCHEMA = """sheet STRUCT<w: BIGINT, h: BIGINT>, frames ARRAY<STRUCT<name: STRING, x: BIGINT, y: BIGINT, w: BIGINT, h: BIGINT, durationMs: BIGINT>>,
 animations MAP<STRING, STRUCT<frames: ARRAY<STRING>, fps: BIGINT, loop: BOOLEAN>>"""


def page_of(index: Column) -> Column:
    return F.floor(index / PAGE)


def unique_frames(frames: DataFrame) -> DataFrame:
    """One row per name: the last frame of that name at the place of the first."""
    cols = [c for c in frames.columns if c not in ("asset_id", "name")]
    g = frames.groupBy("asset_id", "name").agg(F.min("frame_idx").alias("first_idx"), F.max_by(F.struct(*cols), "frame_idx").alias("f"))
    return g.select("asset_id", "name", "first_idx", "f.*")


def _page_json(df: DataFrame, order: str, entry: Column, page: Column) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("e")))), lambda s: s["e"]), ",")
    return df.groupBy("asset_id", page.alias("page")).agg(body.alias("body"))


def _rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def ratio6(v: Column, size: Column) -> Column:
    return F.round(v / F.greatest(F.lit(1), size), 6)


def atlas_json(frames: DataFrame, trim: bool = False) -> DataFrame:
    """JSON hash of frame rectangles, pivot ratios and durations.

    With ``trim``, ``sx, sy, sw, sh`` (frame-local source rectangle) replace the full cell.
    """
    u = unique_frames(frames)
    x, y, w, h = (F.col(c) for c in "xywh")
    src = _rect(F.col("sx"), F.col("sy"), F.col("sw"), F.col("sh")) if trim else _rect(F.lit(0).cast("long"), F.lit(0).cast("long"), w, h)
    frame = _rect(x + F.col("sx"), y + F.col("sy"), F.col("sw"), F.col("sh")) if trim else _rect(x, y, w, h)
    body = F.to_json(F.struct(
        frame.alias("frame"), F.lit(False).alias("rotated"), F.lit(trim).alias("trimmed"), src.alias("spriteSourceSize"),
        F.struct(w.alias("w"), h.alias("h")).alias("sourceSize"),
        F.struct(ratio6(F.col("pivot_x"), w).alias("x"), ratio6(F.col("pivot_y"), h).alias("y")).alias("pivot"), F.col("duration_ms").alias("duration")))
    entry = F.concat(F.lit('"'), F.col("name"), F.lit('":'), body)
    p = _page_json(u, "first_idx", entry, page_of(F.col("first_idx")))
    return p.select("asset_id", "page", F.concat(F.lit('{"frames":{'), F.col("body"), F.lit("}}")).alias("json"))


def recipe_json(frames: DataFrame, sheet_h: Column) -> DataFrame:
    """Import recipe: y-flipped rectangle and normalised pivot per frame."""
    x, y, w, h = (F.col(c) for c in "xywh")
    body = F.to_json(F.struct(
        F.col("name"), _rect(x, y, w, h).alias("rect"), _rect(x, sheet_h - y - h, w, h).alias("flippedRect"),
        F.struct(ratio6(F.col("pivot_x"), w).alias("x"), (F.round(F.lit(1.0) - F.col("pivot_y") / F.greatest(F.lit(1), h), 6) + 0.0).alias("y")).alias("pivotNormalized"),
        F.col("duration_ms").alias("durationMs")))
    p = _page_json(frames, "frame_idx", body, page_of(F.col("frame_idx")))
    return p.select("asset_id", "page", F.concat(F.lit("["), F.col("body"), F.lit("]")).alias("json"))


def _tag_direction(d: Column) -> Column:
    return F.when(d == "reverse", "reverse").when(d.isin("pingpong", "ping-pong"), "pingpong").otherwise("forward")


def frame_tags(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """Tag spans of clips (``hold`` keeps its first frame) with contiguity warnings."""
    span = clip_range(frames, clips).join(clips.select("asset_id", F.col("name").alias("clip"), "direction").hint("merge"), ["asset_id", "clip"])
    steps = clip_order(frames, clips).groupBy("asset_id", "clip").agg(F.count_if(F.col("frame_idx") - F.col("pos") != 0).alias("__x"), F.min(F.col("frame_idx") - F.col("pos")).alias("a"), F.max(F.col("frame_idx") - F.col("pos")).alias("b"))
    j = span.join(steps.drop("__x").hint("merge"), ["asset_id", "clip"], "left")
    hold = F.col("direction") == "hold"
    warn = F.when(F.col("n") == 0, "empty-animation").when(
        (F.col("n") != F.col("end_index") - F.col("start_index") + 1) | (F.col("a") != F.col("b")), "non-contiguous-animation").otherwise("")
    return j.select("asset_id", "clip", F.col("start_index").alias("from_index"), F.when(hold, F.col("start_index")).otherwise(F.col("end_index")).alias("to_index"),
                    _tag_direction(F.col("direction")).alias("direction"), warn.alias("warning"))


def pivot_slices(frames: DataFrame) -> DataFrame:
    return frames.select("asset_id", "frame_idx", F.concat("name", F.lit("_pivot")).alias("slice"), "pivot_x", "pivot_y")


def project_json(frames: DataFrame, tags: DataFrame) -> DataFrame:
    """Project document pages: frame list plus the tag spans of the asset."""
    f = F.to_json(F.struct(F.concat("name", F.lit(".png")).alias("filename"), _rect(*[F.col(c) for c in "xywh"]).alias("frame"), F.col("rotated"), F.col("duration_ms").alias("duration")))
    p = _page_json(frames, "frame_idx", f, page_of(F.col("frame_idx")))
    t = tags.filter("from_index >= 0").groupBy("asset_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        F.col("clip").alias("name"), F.col("from_index").alias("from"), F.col("to_index").alias("to"), "direction")))).alias("tags"))
    return p.join(t, "asset_id", "left").select(
        "asset_id", "page", F.concat(F.lit('{"frames":['), F.col("body"), F.lit('],"meta":{"frameTags":'), F.coalesce("tags", F.lit("[]")), F.lit("}}")).alias("json"))


def import_project(docs: DataFrame) -> DataFrame:
    """Frames of project documents with the tags whose span holds them; rotated frames are flagged.

    Spans are few per document, so the range match is a filter over the tag array in the row.
    """
    d = docs.withColumn("d", F.from_json("json", PROJECT_SCHEMA)).select(
        "asset_id", "page", F.col("d.meta.frameTags").alias("tags"), F.posexplode("d.frames").alias("pos", "f"))
    idx = F.col("page") * PAGE + F.col("pos")
    hit = F.transform(F.filter("tags", lambda t: idx.between(F.least(t["from"], t["to"]), F.greatest(t["from"], t["to"]))), lambda t: t["name"])
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("f.filename", r"\.[^.]+$", ""), "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", "")
    return d.select("asset_id", idx.alias("frame_idx"), name.alias("name"), F.col("f.frame.x").alias("x"), F.col("f.frame.y").alias("y"),
                    F.col("f.frame.w").alias("w"), F.col("f.frame.h").alias("h"), F.coalesce("f.duration", F.lit(120)).alias("duration_ms"),
                    F.array_join(hit, ",").alias("tags"), F.when(F.col("f.rotated"), "rotated-frame").otherwise("").alias("warning"))


def manifest_json(frames: DataFrame, clips: DataFrame, sheets: DataFrame) -> DataFrame:
    """Nested manifest pages: sheet size, frames and the animations map."""
    entry = F.struct(F.col("frame_idx").alias("o"), F.struct("name", "x", "y", "w", "h", F.col("duration_ms").alias("durationMs")).alias("f"))
    p = frames.groupBy("asset_id", page_of(F.col("frame_idx")).alias("page")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["f"]).alias("frames"))
    a = clips.groupBy("asset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("frames", "fps", "loop").alias("v"))))).alias("animations"))
    j = p.join(a, "asset_id", "left").join(sheets, "asset_id")
    return j.select("asset_id", "page", F.to_json(F.struct(F.struct(F.col("sheet_w").alias("w"), F.col("sheet_h").alias("h")).alias("sheet"), "frames", "animations")).alias("json"))


def read_manifests(docs: DataFrame) -> DataFrame:
    return docs.select("asset_id", "page", F.from_json("json", MANIFEST_SCHEMA).alias("m"))


def tileset_companion(sheets: DataFrame) -> DataFrame:
    """Column count, tile count and alignment warnings of ``sheets(asset_id, sheet_w, sheet_h, frame_w, frame_h, margin, spacing, frames, odd_frames)``."""
    def aligned(size: str, tile: str) -> Column:
        room = F.col(size) - F.col("margin") * 2
        return (F.col(tile) >= 1) & (room >= F.col(tile)) & ((room - F.col(tile)) % (F.col(tile) + F.col("spacing")) == 0)

    room = F.col("sheet_w") - F.col("margin") * 2
    cols = F.when((F.col("frame_w") < 1) | (room < F.col("frame_w")), 0).otherwise(F.floor((room + F.col("spacing")) / (F.col("frame_w") + F.col("spacing"))))
    warn = F.array_compact(F.array(
        F.when(~aligned("sheet_w", "frame_w"), F.lit("sheet-width-misaligned")), F.when(~aligned("sheet_h", "frame_h"), F.lit("sheet-height-misaligned")),
        F.when(F.col("odd_frames") > 0, F.lit("frame-size-mismatch"))))
    body = F.to_json(F.struct(F.lit("tileset").alias("type"), F.col("frame_w").alias("tilewidth"), F.col("frame_h").alias("tileheight"), "spacing", "margin",
                              F.col("frames").alias("tilecount"), cols.cast("long").alias("columns"), F.col("sheet_w").alias("imagewidth"), F.col("sheet_h").alias("imageheight")))
    return sheets.select("asset_id", body.alias("json"), F.array_join(warn, ",").alias("warnings"))


# Files written per export target.
TARGET_FILES = {
    "godot": ("godot/README.md", "godot/importer", "godot/import.recipe.json"), "unity": ("unity/README.md", "unity/importer", "unity/import.recipe.json"),
    "phaser": ("phaser/{image}.json", "phaser/README.md", "phaser/import.recipe.json"), "texturepacker": ("texturepacker/{image}.json", "texturepacker/README.md"),
    "tiled": ("tiled/{image}.tileset.json", "tiled/README.md"), "ldtk": ("ldtk/{image}.ldtk-tileset.json", "ldtk/README.md"),
}


def target_files(sheets: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """File rows of every (manifest, target); the target list is a literal array, not a join."""
    rows = [F.struct(F.lit(t).alias("target"), F.lit(p).alias("path")) for t in targets for p in TARGET_FILES[t]]
    rows.append(F.struct(F.lit("all").alias("target"), F.lit("engines/README.md").alias("path")))
    d = sheets.withColumn("f", F.explode(F.array(*rows)))
    return d.select("asset_id", "f.target", F.replace(F.col("f.path"), F.lit("{image}"), F.col("image")).alias("path"),
                    F.when(F.col("f.path").endswith(".json"), "json").otherwise("text").alias("kind"))
