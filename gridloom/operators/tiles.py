"""Tilesets: signatures, tile-size candidates, seams, repairs and tilemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions import color as C
from gridloom.operators.ordering import top_k

TILE_SIZES = (8, 12, 16, 24, 32, 48, 64)
RGB_MAX_DISTANCE = 441.67295593
MISMATCH, LIGHTING, ERROR_SCORE = 0.18, 0.14, 0.6
FNV_START, FNV_PRIME = 2166136261, 16777619
EDGE = ["asset_id", "edge", "row", "col"]


def _fnv(values: Column) -> Column:
    """32-bit FNV-1a over an array of integers."""
    return F.aggregate(values, F.lit(FNV_START).cast("long"),
                       lambda h, v: (h.bitwiseXOR(v) * FNV_PRIME).bitwiseAND(0xFFFFFFFF))


def _packed4() -> Column:
    q = lambda c: F.shiftright(c, 4)
    return (q("r") + F.shiftleft(q("g"), 4) + F.shiftleft(q("b"), 8) + F.when(F.col("a") >= 16, 0x1000).otherwise(0)).cast("long")


def tile_signatures(px: DataFrame, size: Column) -> DataFrame:
    """FNV-1a hash per whole tile over 4-bit RGBA samples at stride floor(sqrt(area / 64)).

    At most about 81 samples per tile are collected, whatever the tile size.
    """
    d = px.withColumn("size", size)
    s = F.col("size")
    stride = F.greatest(F.lit(1), F.floor(F.sqrt(s * s / 64.0)))
    d = d.withColumn("row", F.floor(F.col("y") / s)).withColumn("col", F.floor(F.col("x") / s))
    d = d.filter((F.col("row") < F.floor(F.col("h") / s)) & (F.col("col") < F.floor(F.col("w") / s)))
    ix, iy = F.col("x") - F.col("col") * s, F.col("y") - F.col("row") * s
    d = d.filter((ix % stride == 0) & (iy % stride == 0)).withColumn("pos", iy * s + ix).withColumn("v", _packed4())
    seq = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"])
    return d.groupBy("asset_id", "size", "row", "col").agg(seq.alias("seq"), F.max("w").alias("w"), F.max("h").alias("h")).select(
        "asset_id", "size", "row", "col", "w", "h", _fnv(F.col("seq")).alias("signature"))


def tile_size_candidates(px: DataFrame, sizes: tuple[int, ...] = TILE_SIZES, min_rows: int = 4, min_cols: int = 4, k: int = 5) -> DataFrame:
    """Ranked tile sizes by fit, repetition and grid consistency.

    The published order treats confidences within 0.02 as equal, which is not transitive;
    here confidences are compared in bands of 0.02, then by area.
    """
    d = px.withColumn("size", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes]))).filter(
        F.col("size") <= F.floor(F.least("w", "h") / 2))
    sig = tile_signatures(d, F.col("size"))
    uniq = sig.groupBy("asset_id", "size", "signature").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w"), F.max("h").alias("h"))
    t = uniq.groupBy("asset_id", "size").agg(
        F.sum("n").alias("tiles"), F.count(F.lit(1)).alias("unique_tiles"), F.max("w").alias("w"), F.max("h").alias("h"))
    s = F.col("size")
    rows, cols = F.floor(F.col("h") / s), F.floor(F.col("w") / s)
    repeat = F.lit(1.0) - F.col("unique_tiles") / F.col("tiles")
    fit = F.greatest(F.lit(0.0), F.lit(1.0) - ((F.col("w") % s) / s + (F.col("h") % s) / s) / 2.0)
    grid = (
        F.least(F.lit(1.0), rows / F.lit(min_rows)) + F.least(F.lit(1.0), cols / F.lit(min_cols))
        + F.when(rows * cols >= 16, 1.0).otherwise(rows * cols / 16.0)) / 3.0
    conf = fit * F.lit(0.3) + repeat * F.lit(0.5) + grid * F.lit(0.2)
    t = t.withColumn("repeat_ratio", F.round(repeat, 6)).withColumn("confidence", F.round(conf, 6))
    return top_k(t, ["asset_id"], [F.desc(F.floor(F.col("confidence") / 0.02)), F.desc("size")], k).select(
        "asset_id", "rank", "size", rows.alias("rows"), cols.alias("cols"), "tiles", "unique_tiles", "repeat_ratio", "confidence")


def edge_pairs(px: DataFrame, tile: int) -> DataFrame:
    """Pixel pairs across every inner tile border (right-left and bottom-top).

    Each border pixel is emitted once per border it touches, keyed by the border and the
    position on it; the two sides meet in one grouped aggregate instead of a self join.
    """
    row, col = F.floor(F.col("y") / tile), F.floor(F.col("x") / tile)
    ix, iy = F.col("x") % tile, F.col("y") % tile
    rows, cols = F.floor(F.col("h") / tile), F.floor(F.col("w") / tile)

    def role(edge: str, r: Column, c: Column, pos: Column, side: str) -> Column:
        return F.struct(F.lit(edge).alias("edge"), r.cast("long").alias("row"), c.cast("long").alias("col"), pos.alias("pos"), F.lit(side).alias("side"))

    whole = (row < rows) & (col < cols)
    roles = F.array_compact(F.array(
        F.when(whole & (ix == tile - 1) & (col < cols - 1), role("right-left", row, col, iy, "a")),
        F.when(whole & (ix == 0) & (col > 0), role("right-left", row, col - 1, iy, "b")),
        F.when(whole & (iy == tile - 1) & (row < rows - 1), role("bottom-top", row, col, ix, "a")),
        F.when(whole & (iy == 0) & (row > 0), role("bottom-top", row - 1, col, ix, "b"))))
    border = px.filter((ix == 0) | (ix == tile - 1) | (iy == 0) | (iy == tile - 1)).withColumn("role", F.explode(roles))
    v = F.struct("idx", "r", "g", "b", "a")
    return border.groupBy("asset_id", "role.edge", "role.row", "role.col", "role.pos").agg(
        F.max(F.when(F.col("role.side") == "a", v)).alias("p"), F.max(F.when(F.col("role.side") == "b", v)).alias("q"))


def seam_stats(pairs: DataFrame) -> DataFrame:
    """Mean colour delta (alpha delta where a side is clear) and luma delta per border."""
    chan = lambda s: tuple(F.col(f"{s}.{c}") for c in "rgb")
    vis = lambda s: F.col(f"{s}.a") >= 16
    delta = F.when(vis("p") & vis("q"), F.sqrt(C.distance_sq(chan("p"), chan("q")).cast("double")) / F.lit(RGB_MAX_DISTANCE)).otherwise(
        F.abs(F.col("p.a") - F.col("q.a")) / F.lit(255.0))
    luma = lambda s: F.avg(F.when(vis(s), C.luma709(*chan(s))))
    d = pairs.groupBy(*EDGE).agg(F.avg(delta).alias("edge_delta"), luma("p").alias("lp"), luma("q").alias("lq"))
    light = F.coalesce(F.abs(F.col("lp") - F.col("lq")) / F.lit(255.0), F.lit(0.0))
    return d.select(*EDGE, F.round("edge_delta", 9).alias("edge_delta"), F.round(light, 9).alias("light_delta"))


def seam_summary(stats: DataFrame) -> DataFrame:
    return stats.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("seams"), F.round(F.avg("edge_delta"), 6).alias("avg_delta"),
        F.round(F.max("edge_delta"), 6).alias("max_delta"), F.round(F.max("light_delta"), 6).alias("max_light"))


def seam_issues(stats: DataFrame, mismatch: float = MISMATCH, lighting: float = LIGHTING, limit: int | None = None) -> DataFrame:
    """All issues, numbered in scan order: vertical borders first, mismatch before lighting; a report may pass a ``limit``."""
    code = lambda name, order, col, cut: F.when(F.col(col) >= cut, F.struct(F.lit(order).alias("o"), F.lit(name).alias("code"), F.col(col).alias("score")))
    both = F.array_compact(F.array(code("edge-mismatch", 0, "edge_delta", mismatch), code("lighting-discontinuity", 1, "light_delta", lighting)))
    d = stats.withColumn("i", F.explode(both))
    order = [F.when(F.col("edge") == "right-left", 0).otherwise(1), F.col("row"), F.col("col"), F.col("i.o")]
    d = top_k(d, ["asset_id"], order, limit, "pos") if limit else d.withColumn("pos", F.row_number().over(W.partitionBy("asset_id").orderBy(*order)).cast("long"))
    strategy = F.when(F.col("i.code") == "lighting-discontinuity", "lightingHarmonization").when(
        F.col("i.score") >= ERROR_SCORE, "manualRepaint").otherwise("edgeColorHarmonization")
    return d.select(*EDGE, "pos", F.col("i.code").alias("code"), F.round("i.score", 6).alias("score"),
                    F.when(F.col("i.score") >= ERROR_SCORE, "error").otherwise("warning").alias("severity"), strategy.alias("strategy"))


def repair_seams(px: DataFrame, tile: int, mismatch: float = 0.08) -> DataFrame:
    """Average both sides of every low-risk seam: vertical seams, then horizontal ones on the result.

    A seam with a clear pixel is skipped whole (the published tool keeps its partial edit).
    """
    stats = seam_stats(edge_pairs(px, tile))
    mild = lambda c, cut: (F.col(c) >= cut) & (F.round(c, 6) < ERROR_SCORE)
    todo = stats.filter(mild("edge_delta", mismatch) | mild("light_delta", LIGHTING)).select(*EDGE)
    out = px
    for edge in ("right-left", "bottom-top"):
        pairs = edge_pairs(out, tile).filter(F.col("edge") == edge).join(todo.hint("merge"), EDGE, "left_semi")
        low = F.min(F.least("p.a", "q.a")).over(W.partitionBy(*EDGE))
        pairs = pairs.withColumn("low", low).filter("low >= 16")
        mean = F.struct(*[C.rnd((F.col(f"p.{c}") + F.col(f"q.{c}")) / 2.0).alias(c) for c in "rgba"])
        fix = pairs.withColumn("m", mean).select("asset_id", "m", F.explode(F.array("p.idx", "q.idx")).alias("idx"))
        out = out.join(fix.hint("merge"), ["asset_id", "idx"], "left").select(
            *[F.coalesce(f"m.{c}", c).alias(c) if c in "rgba" else F.col(c) for c in px.columns])
    return out


def tile_cells(px: DataFrame, tile: int) -> DataFrame:
    """Exact tile identity: each cell gets the id of its first equal tile, in scan order.

    Tiles are bounded (``tile`` squared pixels) and reduced to a digest before they meet.
    """
    row, col = F.floor(F.col("y") / tile), F.floor(F.col("x") / tile)
    d = px.withColumn("row", row).withColumn("col", col).filter(
        (F.col("row") < F.floor(F.col("h") / tile)) & (F.col("col") < F.floor(F.col("w") / tile)))
    pos = (F.col("y") % tile) * tile + F.col("x") % tile
    val = F.col("r") * 16777216 + F.col("g") * 65536 + F.col("b") * 256 + F.col("a")
    seen = F.col("a") >= 16
    t = d.groupBy("asset_id", "row", "col").agg(
        F.array_sort(F.collect_list(F.struct(pos.alias("pos"), val.alias("v")))).alias("seq"), F.count_if(seen).alias("n"),
        *[F.sum(F.when(seen, F.col(c)).otherwise(0)).alias(f"s{c}") for c in "rgb"], F.max("w").alias("w"), F.max("h").alias("h"))
    digest = F.md5(F.array_join(F.transform("seq", lambda e: e["v"].cast("string")), ","))
    avg = lambda c: F.when(F.col("n") > 0, C.rnd(F.try_divide(F.col(f"s{c}"), F.col("n")))).otherwise(F.lit(0).cast("long"))
    cells = t.select("asset_id", "row", "col", "w", "h", digest.alias("digest"), C.hex_of(C.pack(avg("r"), avg("g"), avg("b"))).alias("avg_color"))
    first = cells.groupBy("asset_id", "digest").agg(F.min(F.struct("row", "col")).alias("first"), F.count(F.lit(1)).alias("n"))
    ids = first.withColumn("tile_id", (F.row_number().over(W.partitionBy("asset_id").orderBy("first")) - 1).cast("long"))
    return cells.join(ids, ["asset_id", "digest"]).select(
        "asset_id", "row", "col", "w", "h", "tile_id", "n", F.col("first.row").alias("first_row"), F.col("first.col").alias("first_col"), "avg_color")


def tilemap_summary(cells: DataFrame, tile: int, min_repeat: float = 0.25) -> DataFrame:
    t = cells.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("tiles"), (F.max("tile_id") + 1).alias("unique_tiles"), F.max("w").alias("w"), F.max("h").alias("h"))
    repeat = F.lit(1.0) - F.col("unique_tiles") / F.col("tiles")
    rest = ((F.col("w") % tile) + (F.col("h") % tile)) / F.lit(float(tile))
    fit = F.greatest(F.lit(0.0), F.lit(1.0) - rest / 2.0)
    conf = fit * F.lit(0.35) + repeat * F.lit(0.45) + F.least(F.lit(1.0), F.col("tiles") / 16.0) * F.lit(0.2)
    warn = F.array_compact(F.array(
        F.when(rest > 0, F.lit("tilemap-grid-remainder")), F.when(repeat < min_repeat, F.lit("tilemap-low-repeat-confidence")),
        F.when(F.col("unique_tiles") > 256, F.lit("tilemap-high-unique-count"))))
    return t.select("asset_id", "tiles", "unique_tiles", F.round(repeat, 6).alias("repeat_ratio"), F.round(conf, 6).alias("confidence"),
                    F.array_join(warn, ",").alias("warnings"), F.when(repeat < min_repeat, "inspectOnly").otherwise("ready").alias("status"))


def tilemap_rows(cells: DataFrame) -> DataFrame:
    """One JSON list of tile ids per map row; a map row is bounded by the image width."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("col", "tile_id"))), lambda e: e["tile_id"])
    return cells.groupBy("asset_id", "row").agg(F.to_json(ids).alias("ids"))


def validate_tilemap(cells: DataFrame, tiles: DataFrame, meta: DataFrame) -> DataFrame:
    """Problem rows: wrong totals, uneven rows, cells that point to missing tiles."""
    missing = cells.join(tiles.select("asset_id", "tile_id"), ["asset_id", "tile_id"], "left_anti").select(
        "asset_id", F.concat(F.lit("missing tile id "), F.col("tile_id").cast("string")).alias("problem"))
    per_row = cells.groupBy("asset_id", "row").agg(F.count(F.lit(1)).alias("n"))
    uneven = per_row.join(meta, "asset_id").filter(F.col("n") != F.col("cols")).select(
        "asset_id", F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(" width mismatch")).alias("problem"))
    rows = per_row.groupBy("asset_id").agg(F.count(F.lit(1)).alias("nr")).join(meta, "asset_id").filter(
        F.col("nr") != F.col("rows")).select("asset_id", F.lit("row count mismatch").alias("problem"))
    n_tiles = tiles.groupBy("asset_id").agg(F.count(F.lit(1)).alias("nt")).join(meta, "asset_id").filter(
        F.col("nt") != F.col("unique_tiles")).select("asset_id", F.lit("unique tile count mismatch").alias("problem"))
    return missing.unionByName(uneven).unionByName(rows).unionByName(n_tiles).distinct()
