"""Block downsampling: one output pixel per grid cell.

All methods read one reduced table, ``cell_colors`` (one row per cell and exact colour), so
the pixel rows are aggregated once before any shuffle.  Cells are small and keyed by
(asset, cx, cy), which spreads even one very large image over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions import color as C

CELL = ["asset_id", "cx", "cy"]
RGB = ("r", "g", "b")


def to_cells(px: DataFrame, scale: Column, phase_x: Column | int = 0, phase_y: Column | int = 0, partial: bool = False) -> DataFrame:
    """Adds ``cx``, ``cy`` and ``scale``.  Pixels before the phase or in a partial last cell are
    dropped unless ``partial`` is set."""
    px_, py_ = (F.lit(p) if isinstance(p, int) else p for p in (phase_x, phase_y))
    d = px.withColumn("scale", scale).withColumn("__px", px_).withColumn("__py", py_)
    d = d.withColumn("cx", F.floor((F.col("x") - F.col("__px")) / F.col("scale"))).withColumn(
        "cy", F.floor((F.col("y") - F.col("__py")) / F.col("scale")))
    if partial:
        return d.drop("__px", "__py")
    full = (
        (F.col("cx") >= 0) & (F.col("cy") >= 0)
        & (F.col("cx") < F.floor((F.col("w") - F.col("__px")) / F.col("scale")))
        & (F.col("cy") < F.floor((F.col("h") - F.col("__py")) / F.col("scale"))))
    return d.filter(full).drop("__px", "__py")


def cell_colors(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*CELL, "scale", "r", "g", "b", "a").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def _buckets(cc: DataFrame, bucket: Column, more: Sequence[Column] = ()) -> DataFrame:
    """(cell, bucket) rows; fully transparent colours share bucket -1."""
    b = F.when(F.col("a") >= 16, bucket).otherwise(F.lit(-1).cast("long"))
    return cc.groupBy(*CELL, "scale", b.alias("bucket")).agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("n")).alias(f"s{c}") for c in (*RGB, "a")],
        F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"),
        F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"), *more)


def _out(r: Column, g: Column, b: Column, a: Column) -> list[Column]:
    return [v.alias(n) for v, n in zip((r, g, b, a), (*RGB, "a"))]


def dominant(cc: DataFrame) -> DataFrame:
    """Mean colour of the fullest 15-bit bucket.  Equal counts go to the bucket that reached
    the count first, i.e. whose last pixel comes first."""
    return _dominant(cc)


def _dominant(cc: DataFrame, entries: bool = False) -> DataFrame:
    """As ``dominant``; with ``entries``, also the cell's colours as ``_entries`` gathers them."""
    lists = ["all", "vis"] if entries else []
    bk = _buckets(cc, C.bucket15(F.col("r"), F.col("g"), F.col("b")), _entries() if entries else [])
    seen = F.col("bucket") >= 0
    best = F.max_by(F.struct("n", "sr", "sg", "sb"), F.when(seen, F.struct("n", -F.col("last_idx"))))
    cell = bk.groupBy(*CELL).agg(
        F.sum("n").alias("total"), F.sum("sa").alias("sa"), F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("visible"),
        best.alias("best"), F.max(F.when(~seen, F.struct("n", "sr", "sg", "sb"))).alias("clear"), *[F.flatten(F.collect_list(c)).alias(c) for c in lists])
    src = F.when(F.col("visible") > 0, F.col("best")).otherwise(F.col("clear"))
    cell = cell.withColumn("src", src)
    mean = lambda c: C.rnd(F.col(f"src.s{c}") / F.col("src.n"))
    return cell.select(
        *CELL, *_out(mean("r"), mean("g"), mean("b"), C.rnd(F.col("sa") / F.col("total"))),
        F.when(F.col("visible") > 0, F.col("best.n") / F.col("total")).otherwise(F.lit(0.0)).alias("coverage"),
        (F.col("visible") / F.col("total")).alias("visible_coverage"), *lists)


def _entries() -> list[Column]:
    """Colours of a group and their counts: all of them, and the visible ones."""
    entry = F.struct("r", "g", "b", "a", "n")
    return [F.collect_list(entry).alias("all"), F.collect_list(F.when(F.col("a") >= 16, entry)).alias("vis")]


def _medians() -> list[Column]:
    """Median of each channel from ``all`` and ``vis``."""
    vis = F.when(F.size("vis") > 0, F.col("vis")).otherwise(F.col("all"))
    return [*[C.rnd(_middle(vis, c)) for c in RGB], C.rnd(_middle(F.col("all"), "a"))]


def _middle(entries: Column, channel: str) -> Column:
    """Median of ``channel`` over ``entries`` weighted by ``n``; halfway between the two middle values."""
    e = lambda i: F.get(entries, F.lit(i))
    two = F.when(e(0)["n"] > e(1)["n"], e(0)[channel]).when(e(0)["n"] < e(1)["n"], e(1)[channel])
    half = F.aggregate(entries, F.lit(0).cast("long"), lambda s, q: s + q["n"])
    low, high = F.floor((half - 1) / 2), F.floor(half / 2)
    sums = F.aggregate(F.array_sort(F.transform(entries, lambda q: F.struct(q[channel].alias("v"), q["n"].alias("n")))),
                       F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("mid")),
                       lambda s, q: F.struct((s["run"] + q["n"]).alias("run"), (
                           s["mid"] + F.when((s["run"] <= low) & (low < s["run"] + q["n"]), q["v"]).otherwise(0)
                           + F.when((s["run"] <= high) & (high < s["run"] + q["n"]), q["v"]).otherwise(0)).alias("mid")))["mid"]
    some = F.when(F.size(entries) == 1, e(0)[channel] * 2).when(F.size(entries) == 2, F.coalesce(two * 2, e(0)[channel] + e(1)[channel])).otherwise(sums)
    return some / F.lit(2.0)


def median(cc: DataFrame) -> DataFrame:
    """Per-channel median of visible pixels (all pixels if none is visible), weighted by count.

    A cell's colours are one short array, gathered once for all channels; one or two colours
    need no sort, whatever their counts.
    """
    agg = cc.groupBy(*CELL).agg(*_entries())
    return agg.select(*CELL, *_out(*_medians()))


def adaptive(cc: DataFrame, coverage: float = 0.6) -> DataFrame:
    """Dominant colour where it covers enough of the cell, else the median, from one pass over the colours."""
    use = F.col("coverage") >= coverage
    return _dominant(cc, entries=True).select(*CELL, *_out(*[F.when(use, F.col(c)).otherwise(m) for c, m in zip("rgba", _medians())]))


def average(cc: DataFrame) -> DataFrame:
    seen = F.col("a") >= 16
    n = F.col("n")
    agg = cc.groupBy(*CELL).agg(
        F.sum(n).alias("total"), F.sum(F.when(seen, n).otherwise(0)).alias("visible"), F.sum(F.col("a") * n).alias("sa"),
        *[F.sum(F.when(seen, F.col(c) * n).otherwise(0)).alias(f"v{c}") for c in RGB],
        *[F.sum(F.when(~seen, F.col(c) * n).otherwise(0)).alias(f"t{c}") for c in RGB])
    pick = lambda c: C.rnd(F.when(F.col("visible") > 0, F.col(f"v{c}") / F.col("visible")).otherwise(F.col(f"t{c}") / F.col("total")))
    return agg.select(*CELL, *_out(pick("r"), pick("g"), pick("b"), C.rnd(F.col("sa") / F.col("total"))))


def nearest(cells: DataFrame) -> DataFrame:
    """Top-left pixel of each cell: a plain filter, no shuffle."""
    first = lambda p: (F.col(p) - F.col(f"c{p}") * F.col("scale")) == F.col(f"__p{p}")
    d = cells.withColumn("__px", F.pmod(F.col("x") - F.col("cx") * F.col("scale"), F.col("scale")))
    d = d.withColumn("__py", F.pmod(F.col("y") - F.col("cy") * F.col("scale"), F.col("scale")))
    return d.filter((F.col("__px") == 0) & (F.col("__py") == 0) & first("x") & first("y")).select(*CELL, "r", "g", "b", "a")


def bilinear(cells: DataFrame) -> DataFrame:
    """Alpha-weighted taps around the cell centre: weights 1 - |offset - (s-1)/2| per axis."""
    mid = (F.col("scale") - 1) / 2.0
    off = lambda p: F.abs(F.col(p) - F.col(f"c{p}") * F.col("scale") - mid)
    wt = F.greatest(F.lit(0.0), F.lit(1.0) - off("x")) * F.greatest(F.lit(0.0), F.lit(1.0) - off("y"))
    d = cells.withColumn("wt", wt).filter(F.col("wt") > 0)
    seen = F.col("a") >= 16
    agg = d.groupBy(*CELL).agg(
        F.sum(F.when(seen, F.col("wt")).otherwise(0.0)).alias("vw"), F.sum(F.col("wt") * F.col("a")).alias("sa"),
        *[F.sum(F.when(seen, F.col("wt") * F.col(c)).otherwise(0.0)).alias(f"v{c}") for c in RGB],
        *[F.sum(F.col("wt") * F.col(c)).alias(f"t{c}") for c in RGB])
    pick = lambda c: C.rnd(F.when(F.col("vw") > 0, F.col(f"v{c}") / F.col("vw")).otherwise(F.col(f"t{c}")))
    return agg.select(*CELL, *_out(pick("r"), pick("g"), pick("b"), C.rnd(F.col("sa"))))


def _feature_cell(cc: DataFrame, bucket: Column, score) -> DataFrame:
    """Dominant bucket of each cell unless another supported bucket scores above zero.

    ``score(dominant, cluster, visible, span)`` gives a double, null when unsupported.
    Buckets per cell are few, so the comparison is a window over the cell.
    """
    bk = _buckets(cc, bucket)
    w = W.partitionBy(*CELL)
    seen = F.col("bucket") >= 0
    d = (
        bk.withColumn("total", F.sum("n").over(w)).withColumn("cell_sa", F.sum("sa").over(w))
        .withColumn("visible", F.sum(F.when(seen, F.col("n")).otherwise(0)).over(w))
        .withColumn("dom", F.max(F.when(seen, F.struct("n", (-F.col("last_idx")).alias("nl"), "bucket", "sr", "sg", "sb"))).over(w)))
    dom = tuple(F.col(f"dom.s{c}") / F.col("dom.n") for c in RGB)
    own = tuple(F.col(f"s{c}") / F.col("n") for c in RGB)
    span_x, span_y = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    sc = F.when(seen & (F.col("bucket") != F.col("dom.bucket")), F.round(score(dom, own, span_x, span_y), 9))
    d = d.withColumn("score", sc)
    pick = F.max_by(F.struct("n", "sr", "sg", "sb"), F.when(F.col("score") > 0, F.struct("score", -F.col("first_idx"))))
    cell = d.groupBy(*CELL).agg(F.max("total").alias("total"), F.max("cell_sa").alias("sa"), F.max("visible").alias("visible"),
                                F.max("dom").alias("dom"), pick.alias("pick"))
    has = F.col("pick").isNotNull()
    mean = lambda c: F.when(F.col("visible") == 0, F.lit(0).cast("long")).otherwise(
        C.rnd(F.when(has, F.col(f"pick.s{c}") / F.col("pick.n")).otherwise(F.col(f"dom.s{c}") / F.col("dom.n"))))
    return cell.select(*CELL, *_out(mean("r"), mean("g"), mean("b"), C.rnd(F.col("sa") / F.col("total"))))


def detail_preserving(cc: DataFrame) -> DataFrame:
    """A contrasting bucket wins if it covers 12 % of the visible cell or forms a line."""
    def score(dom, own, sx, sy):
        side, n, vis = F.col("scale"), F.col("n"), F.col("visible")
        line = (sx >= side * F.lit(0.65)) | (sy >= side * F.lit(0.65))
        ok = (n >= F.greatest(F.lit(2), F.ceil(vis * F.lit(0.12)))) | (line & (n >= F.greatest(F.lit(2), F.ceil(side * F.lit(0.65)))))
        luma = F.abs(C.luma601(*own) - C.luma601(*dom))
        chroma = F.sqrt(C.distance_sq(dom, own))
        s = (luma + chroma * F.lit(0.4)) * F.when(line, 1.25).otherwise(1.0) * F.least(F.lit(1.0), n / vis / F.lit(0.25))
        return F.when(ok & ((luma >= 36) | (chroma >= 52)), s)

    return _feature_cell(cc, C.five_bit(C.pack(F.col("r"), F.col("g"), F.col("b"))), score)


def contrast(cc: DataFrame) -> DataFrame:
    """As ``detail_preserving`` on 2-bit buckets, with luma and chroma weighed apart."""
    loose = F.shiftleft(F.shiftright("r", 6), 4) + F.shiftleft(F.shiftright("g", 6), 2) + F.shiftright("b", 6)

    def score(dom, own, sx, sy):
        side, n, vis = F.col("scale"), F.col("n"), F.col("visible")
        line = (sx >= side * F.lit(0.45)) | (sy >= side * F.lit(0.45))
        ok = (n >= F.greatest(F.lit(2), F.ceil(vis * F.lit(0.05)))) | (line & (n >= F.greatest(F.lit(2), F.ceil(side * F.lit(0.45)))))
        lo, ld = C.luma601(*own), C.luma601(*dom)
        luma = F.abs(lo - ld)
        chroma = F.abs((own[0] - lo) - (dom[0] - ld)) + F.abs((own[2] - lo) - (dom[2] - ld))
        cov = n / vis
        s = (
            (luma * F.lit(1.45) + chroma * F.lit(0.35)) * F.when(line & (cov <= 0.2), 1.65).otherwise(1.0)
            * F.when(lo < ld - 48, 1.35).otherwise(1.0) * F.greatest(F.lit(0.4), F.least(F.lit(1.0), cov / F.lit(0.18))))
        return F.when(ok & ((luma >= 48) | (chroma >= 42)), s)

    return _feature_cell(cc, loose.cast("long"), score)


def block_purity(cc: DataFrame) -> DataFrame:
    """Mean share of the top 12-bit bucket over cells with visible pixels."""
    b12 = C.bucket12(F.col("r"), F.col("g"), F.col("b"))
    bk = cc.filter("a >= 16").groupBy(*CELL, b12.alias("bucket")).agg(F.sum("n").alias("n"))
    cell = bk.groupBy(*CELL).agg((F.max("n") / F.sum("n")).alias("share"))
    return cell.groupBy("asset_id").agg(F.round(F.avg("share"), 6).alias("purity"), F.count(F.lit(1)).alias("cells"))


def regularise_mixels(cells: DataFrame) -> DataFrame:
    """Paint noisy homogeneous cells with their dominant colour; keep structured cells.

    A cell is structured when it mixes opaque and clear pixels, or when its opaque pixels
    deviate from their mean by more than 24 per channel on average.
    """
    cc = cell_colors(cells)
    n, op = F.col("n"), F.col("a") >= 16
    w = W.partitionBy(*CELL)
    m = cc.withColumn("op_n", F.sum(F.when(op, n).otherwise(0)).over(w)).withColumn("tr_n", F.sum(F.when(~op, n).otherwise(0)).over(w))
    for c in RGB:
        m = m.withColumn(f"m{c}", F.try_divide(F.sum(F.when(op, F.col(c) * n).otherwise(0)).over(w), F.col("op_n")))
    dev = F.sum(F.when(op, n * C.l1(tuple(F.col(c) for c in RGB), tuple(F.col(f"m{c}") for c in RGB))))
    info = m.groupBy(*CELL).agg(F.max("op_n").alias("op_n"), F.max("tr_n").alias("tr_n"), dev.alias("dev"))
    keep = F.when(F.col("op_n") == 0, F.lit(False)).when(F.col("tr_n") > 0, F.lit(True)).otherwise(
        F.round(F.col("dev") / (F.col("op_n") * 3), 9) > 24)
    info = info.select(*CELL, keep.alias("structured"))
    paint = dominant(cc).select(*CELL, *[F.col(c).alias(f"d{c}") for c in RGB])
    j = cells.join(info.join(paint, CELL), CELL)
    flat = ~F.col("structured")
    clear = flat & (F.col("a") == 0)
    val = lambda c: F.when(clear, 0).when(flat, F.col(f"d{c}")).otherwise(F.col(c)).cast("long")
    return j.select("asset_id", "idx", *[val(c).alias(c) for c in RGB], "a", "structured")
