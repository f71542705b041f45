"""Background model from the rim of an image: colour clusters, a robust threshold, and a checkerboard search.

The rim is reduced to a table of colours (one row per asset and colour), and medians, quantiles and
deviations are read from running sums over it. The checkerboard search needs places as well, but a
place only through its remainders: for one cell size, the parity of a pixel under any phase follows
from x and y modulo two cells. Assets that cannot hold a neutral two-tone board are left out first,
by a bound that every board keeps.

All rim pixels count; those of the last row and the last column count twice each, as published.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.operators.ordering import top_k
from gridloom.session import cut_lineage

# Fixed values of the model.
VISIBLE, MIN_THRESHOLD, MAX_THRESHOLD = 16, 0.02, 0.1
SECOND_SHARE, SECOND_DISTANCE, MEMBER_DISTANCE = 0.18, 0.06, 0.12
MAX_CHROMA, MIN_LIGHTNESS_STEP, MAX_DEVIATION, MIN_AGREEMENT = 0.04, 0.04, 0.025, 0.85
CELLS = (4, 5, 6, 8, 10, 12, 16, 20, 24, 32)
MODEL = ["asset_id", "kind", "first", "second", "threshold", "confidence", "cell", "phase_x", "phase_y", "score", "radius1", "radius2"]
_LAB = ("l", "a", "b")


def rim(px: DataFrame) -> DataFrame:
    """Visible rim pixels with ``color``, their OKLab values ``ok`` and weight ``t``; ``border`` marks the outermost lines."""
    w, h = F.col("w"), F.col("h")
    width = F.greatest(F.lit(8), F.least(F.lit(64), F.floor(F.least(w, h) * F.lit(0.02) + 0.5)))
    band = F.least(width, F.ceil(w / 2), F.ceil(h / 2))
    inside = (F.col("x") < band) | (F.col("y") < band) | (F.col("x") >= w - band) | (F.col("y") >= h - band)
    t = F.lit(1) + (F.col("y") == h - 1).cast("long") + (F.col("x") == w - 1).cast("long")
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == w - 1) | (F.col("y") == h - 1)
    return px.where(inside).select("asset_id", "x", "y", "a", C.pack(F.col("r"), F.col("g"), F.col("b")).alias("color"), t.cast("long").alias("t"), border.alias("border"))


def _distance(p: Column, q: Column) -> Column:
    return F.round(F.sqrt(sum(((p[k] - q[k]) * (p[k] - q[k]) for k in "ab"), (p["l"] - q["l"]) * (p["l"] - q["l"]))), 9)


def _quantile(rows: DataFrame, value: str, share: float, name: str) -> DataFrame:
    """Value at place ``floor((total - 1) * share)`` of the sorted, weighted values of each asset."""
    runs = rows.groupBy("asset_id", F.col(value).alias("v")).agg(F.sum("n").alias("n"))
    total = runs.groupBy("asset_id").agg(F.floor((F.sum("n") - 1) * F.lit(share)).alias("place"))
    seen = F.sum("n").over(W.partitionBy("asset_id").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    return runs.withColumn("seen", seen).join(total, "asset_id").where("seen > place").groupBy("asset_id").agg(F.min("v").alias(name))


def _buckets(colors: DataFrame) -> DataFrame:
    """The two fullest 12-bit buckets with their mean colours, in one row; where bucket 0 leads it is its own second, as published."""
    r, g, b = C.rgb(F.col("color"))
    d = colors.withColumn("bucket", C.bucket12(r, g, b)).groupBy("asset_id", "bucket").agg(F.sum("n").alias("n"), *[F.sum(v * F.col("n")).alias(k) for k, v in zip("rgb", (r, g, b))])
    top = top_k(d, ["asset_id"], [F.desc("n"), F.asc("bucket")], 2)
    mean = C.pack(*[C.rnd(F.col(k) / F.col("n")) for k in "rgb"])
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    two = top.withColumn("mean", mean).groupBy("asset_id").agg(*[pick(k, c).alias(f"{c}{k}") for k in (1, 2) for c in ("n", "mean", "bucket")])
    own = (F.col("bucket1") == 0) | F.col("n2").isNull()
    alone = F.col("bucket1") == 0
    return two.select("asset_id", "n1", F.when(alone, F.col("n1")).otherwise(F.coalesce("n2", F.lit(0))).alias("n2"), "mean1", F.when(~own, F.col("mean2")).alias("mean2"))


def _centre(colors: DataFrame, seeds: DataFrame, mean: str, name: str) -> DataFrame:
    """Channel medians of the colours near a seed."""
    near = colors.join(seeds.where(F.col(mean).isNotNull()).select("asset_id", C.oklab_struct(F.col(mean)).alias("m")), "asset_id").where(_distance(F.col("ok"), F.col("m")) <= MEMBER_DISTANCE)
    r, g, b = C.rgb(F.col("color"))
    out = None
    for k, v in zip("rgb", (r, g, b)):
        one = _quantile(near.withColumn(k, v), k, 0.5, k)
        out = one if out is None else out.join(one, "asset_id")
    return out.select("asset_id", C.pack(F.col("r"), F.col("g"), F.col("b")).alias(name))


def _nearest(colors: DataFrame, centres: DataFrame) -> DataFrame:
    """``d``: distance of each colour to the nearer centre (``lab1``, ``lab2``; the second may be null)."""
    return colors.join(centres, "asset_id").withColumn("d", F.least(_distance(F.col("ok"), F.col("lab1")), _distance(F.col("ok"), F.col("lab2"))))


def _radius(colors: DataFrame, both: DataFrame, lab: str, name: str) -> DataFrame:
    """Largest distance to a centre among its members, 0 without any."""
    j = colors.join(both.select("asset_id", F.col(lab).alias("m")), "asset_id").withColumn("d", _distance(F.col("ok"), F.col("m"))).where(F.col("d") <= MEMBER_DISTANCE)
    return j.groupBy("asset_id").agg(F.round(F.max("d"), 6).alias(name))


def checkerboards(edge: DataFrame) -> DataFrame:
    """``asset_id, cell, phase_x, phase_y, score`` and both tones (mean OKLab ``b1, b2``, packed ``f1, f2``, deviation ``w1, w2``): the best board of each asset that has one."""
    ok = F.col("ok")
    chroma = ok["a"] * ok["a"] + ok["b"] * ok["b"]
    # Two tight clusters of low chroma keep the mean square chroma below the sum of both bounds, and differ in lightness.
    stats = edge.groupBy("asset_id").agg((F.sum(chroma * F.col("t")) / F.sum("t")).alias("c"), (F.max("ok.l") - F.min("ok.l")).alias("range"))
    could = stats.where((F.col("c") <= (MAX_CHROMA**2 + MAX_DEVIATION**2) * 1.001) & (F.col("range") >= MIN_LIGHTNESS_STEP - 1e-6)).select("asset_id")
    d = edge.join(could, "asset_id", "left_semi").withColumn("cell", F.explode(F.array(*[F.lit(c) for c in CELLS])))
    left = d.groupBy("asset_id", "cell", (F.col("x") % (F.col("cell") * 2)).alias("rx"), (F.col("y") % (F.col("cell") * 2)).alias("ry"), "color", "ok").agg(F.sum("t").alias("n"))
    phases = F.array_distinct(F.array(*[F.floor(F.col("cell") * k / 4).cast("long") for k in range(4)]))
    left = left.withColumn("phase_x", F.explode(phases)).withColumn("phase_y", F.explode(phases))
    side = lambda r, p: F.floor((F.col(r) - F.col(p)) / F.col("cell"))
    board = ["asset_id", "cell", "phase_x", "phase_y"]
    by = cut_lineage(left.groupBy(*board, F.pmod(side("rx", "phase_x") + side("ry", "phase_y"), F.lit(2)).cast("int").alias("odd"), "color", "ok").agg(F.sum("n").alias("n")))
    r, g, b = C.rgb(F.col("color"))
    means = by.groupBy(*board, "odd").agg(
        F.sum("n").alias("n"), F.struct(*[F.round(F.sum(ok[k] * F.col("n")) / F.sum("n"), 9).alias(k) for k in _LAB]).alias("m"),
        C.pack(*[C.rnd(F.sum(v * F.col("n")) / F.sum("n")) for v in (r, g, b)]).alias("rgb"))
    pick = lambda k, c: F.max(F.when(F.col("odd") == k, F.col(c)))
    two = means.groupBy(*board).agg(*[pick(k, c).alias(f"{c}{k}") for k in (0, 1) for c in ("n", "m", "rgb")]).where("n0 IS NOT NULL AND n1 IS NOT NULL")
    flat = lambda m: F.sqrt(F.col(f"{m}.a") * F.col(f"{m}.a") + F.col(f"{m}.b") * F.col(f"{m}.b")) <= MAX_CHROMA
    two = two.where(flat("m0") & flat("m1") & (F.round(F.abs(F.col("m0.l") - F.col("m1.l")), 9) >= MIN_LIGHTNESS_STEP))
    j = by.join(two, board).withColumns({"d0": _distance(ok, F.col("m0")), "d1": _distance(ok, F.col("m1"))})
    even = F.col("odd") == 0
    agree = F.when(even, F.col("d0") <= F.col("d1")).otherwise(F.col("d1") < F.col("d0"))
    dev = lambda test, d: F.round(F.sqrt(F.sum(F.when(test, F.col(d) * F.col(d) * F.col("n"))) / F.sum(F.when(test, F.col("n")))), 9)
    g2 = j.groupBy(*board).agg(dev(even, "d0").alias("s0"), dev(~even, "d1").alias("s1"), (F.sum(F.when(agree, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    good = g2.where((F.col("s0") <= MAX_DEVIATION) & (F.col("s1") <= MAX_DEVIATION) & (F.col("share") >= MIN_AGREEMENT)).withColumn("score", F.floor(F.round(F.col("share"), 9) * 1000 + 0.5) / 1000)
    # The first board tried wins ties, but among equal ones the last of 16 pixels replaces all.
    late = F.col("cell") == 16
    sign = F.when(late, 1).otherwise(-1)
    order = F.struct("score", late.cast("int"), sign * F.col("cell"), sign * F.col("phase_x"), sign * F.col("phase_y"))
    best = good.groupBy("asset_id").agg(F.max_by(F.struct("cell", "phase_x", "phase_y", "score", "s0", "s1"), order).alias("b")).select("asset_id", "b.*")
    return best.join(two, board).select("asset_id", "cell", "phase_x", "phase_y", "score", F.col("m0").alias("b1"), F.col("m1").alias("b2"), F.col("rgb0").alias("f1"), F.col("rgb1").alias("f2"), F.round("s0", 6).alias("w1"), F.round("s1", 6).alias("w2"))


def background_model(px: DataFrame) -> DataFrame:
    """One row per asset (columns of ``MODEL``), see ``background_clusters``."""
    return background_clusters(px).select(*MODEL)


def background_clusters(px: DataFrame) -> DataFrame:
    """One row per asset, the columns of ``MODEL`` and the OKLab centres ``lab1, lab2`` with radii ``radius1, radius2``: kind, one or two packed colours, OKLab threshold, confidence, and the board if there is one.

    Assets whose border is almost clear, or without visible rim pixels, get the colour of their
    first pixel, the least threshold and confidence 0.
    """
    all_rim = rim(px)
    border = all_rim.where("border").groupBy("asset_id").agg((F.count_if(F.col("a") >= VISIBLE) / F.count(F.lit(1))).alias("open"))
    some = border.where("open >= 0.05").select("asset_id")
    edge = cut_lineage(all_rim.where(F.col("a") >= VISIBLE).join(some, "asset_id", "left_semi").withColumn("ok", C.oklab_struct(F.col("color"))))
    colors = cut_lineage(edge.groupBy("asset_id", "color", "ok").agg(F.sum("t").alias("n")))
    seeds = cut_lineage(_buckets(colors))
    both = cut_lineage(seeds.join(_centre(colors, seeds, "mean1", "first"), "asset_id").join(_centre(colors, seeds, "mean2", "second"), "asset_id", "left"))
    lab = lambda c: F.when(F.col(c).isNotNull(), C.oklab_struct(F.col(c)))
    both = both.withColumns({"lab1": lab("first"), "lab2": lab("second")})
    far = (F.col("n2") / F.col("n1") >= SECOND_SHARE) & (_distance(F.col("lab1"), F.col("lab2")) > SECOND_DISTANCE)
    keep = F.coalesce(far, F.lit(False))
    both = both.select("asset_id", "n1", "n2", "first", F.when(keep, F.col("second")).alias("second"), "lab1", F.when(keep, F.col("lab2")).alias("lab2"))
    both = both.join(_radius(colors, both, "lab1", "radius1"), "asset_id", "left").join(_radius(colors, both, "lab2", "radius2"), "asset_id", "left")
    boards = cut_lineage(checkerboards(edge))

    dist = _nearest(colors, both.select("asset_id", "lab1", "lab2"))
    med = _quantile(dist, "d", 0.5, "med")
    mad = _quantile(dist.join(med, "asset_id").withColumn("dev", F.round(F.abs(F.col("d") - F.col("med")), 9)), "dev", 0.5, "mad")
    q95 = _quantile(dist, "d", 0.95, "q95")
    r, g, b = C.rgb(F.col("color"))
    grey = F.when(C.spread(r, g, b) <= 28, r + g + b)
    neutral = colors.groupBy("asset_id").agg(((F.sum(F.when(grey.isNotNull(), F.col("n")).otherwise(0)) >= F.sum("n") * F.lit(0.9)) & (F.max(grey) - F.min(grey) >= 36)).alias("neutral"))
    d = both.join(med, "asset_id").join(mad, "asset_id").join(q95, "asset_id").join(neutral, "asset_id").join(
        boards, "asset_id", "left")
    wide = F.greatest(F.col("q95"), F.col("med") + F.col("mad") * F.lit(3 * 1.4826))
    wide = F.when(F.col("cell").isNull() & F.coalesce("neutral", F.lit(False)), F.greatest(wide, F.lit(MAX_THRESHOLD))).otherwise(wide)
    d = d.withColumn("threshold", F.round(F.greatest(F.lit(MIN_THRESHOLD), F.least(F.lit(MAX_THRESHOLD), wide)), 6))
    board = F.col("cell").isNotNull()
    d = d.select("asset_id", "n1", "n2", "threshold", "cell", "phase_x", "phase_y", "score", F.when(board, F.col("f1")).otherwise(F.col("first")).alias("first"), F.when(board, F.col("f2")).otherwise(F.col("second")).alias("second"),
                 F.when(board, F.col("b1")).otherwise(F.col("lab1")).alias("lab1"), F.when(board, F.col("b2")).otherwise(F.col("lab2")).alias("lab2"),
                 F.when(board, F.col("w1")).otherwise(F.coalesce("radius1", F.lit(0.0))).alias("radius1"), F.when(board, F.col("w2")).when(F.col("second").isNotNull(), F.coalesce("radius2", F.lit(0.0))).alias("radius2"))
    d = cut_lineage(d)

    size = edge.groupBy("asset_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    side = F.when(F.col("y") == 0, 0).when(F.col("y") == F.col("my"), 1).when(F.col("x") == 0, 2).when(F.col("x") == F.col("mx"), 3)
    sides = _nearest(edge.join(size, "asset_id").withColumn("side", side).where("side IS NOT NULL").groupBy("asset_id", "side", "color", "ok").agg(F.sum("t").alias("n")), d.select("asset_id", "lab1", "lab2"))
    cover = sides.groupBy("asset_id", "side").agg((F.sum(F.when(F.col("d") <= MEMBER_DISTANCE, F.col("n")).otherwise(0)) / F.sum("n")).alias("part"))
    least = cover.groupBy("asset_id").agg(F.min("part").alias("part"))
    d = d.join(least, "asset_id", "left").withColumn("part", F.coalesce("part", F.lit(0.0)))
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(MAX_THRESHOLD) - F.col("threshold")) / F.lit(MAX_THRESHOLD - MIN_THRESHOLD)))
    conf = F.greatest(F.col("part") * F.col("part") * 0.5 + quality * 0.3 + (F.col("n1") - F.col("n2")) / F.col("n1") * 0.2, F.coalesce("score", F.lit(0.0)))
    kind = F.when(F.col("cell").isNotNull(), "checkerboard").when(F.col("second").isNotNull(), "multi").otherwise("solid")
    known = d.select("asset_id", kind.alias("kind"), "first", "second", "threshold", (F.floor(F.round(F.least(F.lit(1.0), conf), 9) * 1000 + 0.5) / 1000).alias("confidence"), "cell", "phase_x", "phase_y", "score", "lab1", "lab2", "radius1", "radius2")
    start = px.where("idx = 0").select("asset_id", C.pack(F.col("r"), F.col("g"), F.col("b")).alias("first")).join(known.select("asset_id"), "asset_id", "left_anti")
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    own = start.withColumn("lab1", C.oklab_struct(F.col("first")))
    rest = own.select("asset_id", F.lit("solid").alias("kind"), "first", null("long", "second"), F.lit(MIN_THRESHOLD).alias("threshold"), F.lit(0.0).alias("confidence"),
                        null("int", "cell"), null("long", "phase_x"), null("long", "phase_y"), null("double", "score"), "lab1", F.when(F.lit(False), F.col("lab1")).alias("lab2"), F.lit(0.0).alias("radius1"), null("double", "radius2"))
    return known.unionByName(rest)
