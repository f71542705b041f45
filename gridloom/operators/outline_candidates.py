"""Colours that may be an outline, with the evidence for each: where they lie, what they touch, what lies behind them.

The exterior is flooded once; the depth of every other pixel is its city-block distance to it, read
from running minima along image lines (no walk). Boundary pixels look at the pixels behind them
through one equi-join on places. Everything else is one grouped pass over 12-bit colour buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.operators.alpha import corner_mean
from gridloom.operators.background import background_clusters
from gridloom.operators.components import exterior
from gridloom.operators.ordering import top_k
from gridloom.session import cut_lineage

# Fixed values of the evidence rule.
ALPHA, CORNER_TOLERANCE, FRINGE_SHARE, LIKE_MARGIN, FAMILY_CHROMA, FAMILY_COSINE = 8, 18, 0.2, 0.035, 0.05, 0.9
DARKER_BY, DARK = 12, 64
EVIDENCE = [
    "count", "contact", "interior", "score", "repair_score", "confidence", "label", "separation", "distance1", "distance2", "distance3", "support", "darker1", "darker2", "fringe",
]


def depth_from(px: DataFrame, outside: Column) -> DataFrame:
    """``depth``: city-block distance to the nearest pixel with ``outside``, 0 there, null in images without any."""
    row, col = W.partitionBy("asset_id", "y").orderBy("x"), W.partitionBy("asset_id", "x").orderBy("y")
    back, ahead = (W.unboundedPreceding, 0), (0, W.unboundedFollowing)
    d = px.withColumn("__x", F.when(outside, F.col("x")))
    along = F.least(F.col("x") - F.max("__x").over(row.rowsBetween(*back)), F.min("__x").over(row.rowsBetween(*ahead)) - F.col("x"))
    d = d.withColumn("__d", along)
    down = F.least(F.min(F.col("__d") - F.col("y")).over(col.rowsBetween(*back)) + F.col("y"), F.min(F.col("__d") + F.col("y")).over(col.rowsBetween(*ahead)) - F.col("y"))
    return d.withColumn("depth", down).drop("__x", "__d")


def bucket_background(px: DataFrame, clusters: DataFrame) -> DataFrame:
    """``asset_id, bucket, separation, like, family``: how each occurring colour bucket relates to the background clusters."""
    b = C.bucket12(F.col("r"), F.col("g"), F.col("b"))
    mid = lambda k: F.shiftright("bucket", k).bitwiseAND(15) * 16 + 8
    seen = px.groupBy("asset_id", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).withColumn("ok", C.oklab_struct(C.pack(mid(8), mid(4), mid(0)).cast("long")))
    limit = F.greatest(F.col("threshold"), F.col("radius1") + LIKE_MARGIN, F.col("radius2") + LIKE_MARGIN)
    d = seen.join(clusters.select("asset_id", limit.alias("limit"), "lab1", "lab2"), "asset_id")
    ok = F.col("ok")
    dist = lambda m: F.round(F.sqrt(sum(((ok[k] - F.col(m)[k]) * (ok[k] - F.col(m)[k]) for k in "ab"), (ok["l"] - F.col(m)["l"]) * (ok["l"] - F.col(m)["l"]))), 9)
    chroma = lambda v: F.sqrt(v["a"] * v["a"] + v["b"] * v["b"])

    def kin(m: str) -> Column:
        v = F.col(m)
        return F.coalesce((chroma(ok) > FAMILY_CHROMA) & (chroma(v) > FAMILY_CHROMA) & (F.round((ok["a"] * v["a"] + ok["b"] * v["b"]) / (chroma(ok) * chroma(v)), 9) >= FAMILY_COSINE), F.lit(False))

    sep = F.least(dist("lab1"), dist("lab2"))
    return d.select("asset_id", "bucket", sep.alias("separation"), (sep <= F.col("limit")).alias("like"), (kin("lab1") | kin("lab2")).alias("family"), "limit")


def outline_candidates(px: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` best candidates per asset: ``asset_id, rank, color`` and ``EVIDENCE``; assets with fewer than two boundary pixels have none."""
    clusters = cut_lineage(background_clusters(px))
    kinds = cut_lineage(bucket_background(px, clusters))
    size = F.greatest(F.lit(1), F.least(F.lit(8), F.floor(F.least("w", "h") / 4)))
    b12 = C.bucket12(F.col("r"), F.col("g"), F.col("b"))
    d = px.select("asset_id", "idx", "x", "y", "w", "h", "r", "g", "b", "a").withColumn("bucket", b12).join(kinds.select("asset_id", "bucket", "like"), ["asset_id", "bucket"]).join(corner_mean(px, size), "asset_id")
    corner = C.l1(tuple(F.col(c) for c in "rgba"), tuple(F.col(f"bg_{c}") for c in "rgba")) <= CORNER_TOLERANCE
    d = cut_lineage(d.withColumn("bg", (F.col("a") <= ALPHA) | F.col("like") | corner).drop("like", *[f"bg_{c}" for c in "rgba"]))
    out = exterior(d, F.col("bg")).withColumn("out", F.lit(True))
    d = d.join(out, ["asset_id", "idx"], "left").withColumn("out", F.coalesce("out", F.lit(False)))
    d = depth_from(d, F.col("out"))
    row, col = W.partitionBy("asset_id", "y").orderBy("x"), W.partitionBy("asset_id", "x").orderBy("y")
    touches = lambda side, w: F.coalesce(side("out").over(w), F.lit(True)).cast("long")  # noqa: E731  # beyond the image counts as outside
    d = d.withColumn("contact", touches(F.lag, row) + touches(F.lead, row) + touches(F.lag, col) + touches(F.lead, col))
    luma = F.col("r") * 2126 + F.col("g") * 7152 + F.col("b") * 722
    d = cut_lineage(d.where((F.col("a") > ALPHA) & ~F.col("out")).withColumn("luma", luma).select("asset_id", "idx", "x", "y", "bucket", "depth", "contact", "luma", C.pack(F.col("r"), F.col("g"), F.col("b")).alias("color")))

    steps = F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dy in range(-2, 3) for dx in range(-2, 3) if (dx, dy) != (0, 0)])
    edge = d.where("contact > 0")
    look = edge.where("depth IS NOT NULL").select("asset_id", "idx", F.col("bucket").alias("b0"), F.col("depth").alias("d0"), F.col("luma").alias("l0"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.explode(steps).alias("s"))
    look = look.withColumn("x", F.col("x0") + F.col("s.dx")).withColumn("y", F.col("y0") + F.col("s.dy")).withColumn("reach", F.greatest(F.abs("s.dx"), F.abs("s.dy")))
    j = look.join(d.select("asset_id", "x", "y", "bucket", "depth", "luma"), ["asset_id", "x", "y"]).where(
        (F.col("bucket") != F.col("b0")) & (F.col("depth") > F.col("d0")) & ((F.col("luma") + DARKER_BY * 10000 < F.col("l0")) | (F.col("luma") <= DARK * 10000)))
    found = j.groupBy("asset_id", "idx").agg(F.max(((F.col("reach") == 1) & (F.col("depth") <= F.col("d0") + 1)).cast("int")).alias("near"), F.max((F.col("depth") <= F.col("d0") + 2).cast("int")).alias("wide"))
    marked = d.join(found, ["asset_id", "idx"], "left")
    on = F.col("contact") > 0
    flag = lambda c: F.sum(F.when(on, F.coalesce(c, F.lit(0))).otherwise(0))
    g = marked.groupBy("asset_id", "bucket").agg(
        F.count_if(on).alias("count"), F.sum("contact").alias("contact"), F.count_if(~on).alias("interior"), F.count_if(~on & (F.col("depth") <= 2)).alias("n2"), F.count_if(~on & ((F.col("depth") > 2) | F.col("depth").isNull())).alias("n3"),
        flag("near").alias("inner1"), flag("wide").alias("inner2"), F.min_by(F.when(on, F.col("color")), F.when(on, F.col("idx"))).alias("color"))
    total = g.groupBy("asset_id").agg(F.sum("count").alias("tb"), F.sum("contact").alias("tc"), F.sum("interior").alias("ti"))
    e = g.where("count > 0").join(total, "asset_id").where("tb >= 2").join(kinds, ["asset_id", "bucket"]).where("NOT like")
    one = F.lit(1)
    cover, touch = F.col("count") / F.col("tb"), F.col("contact") / F.greatest(one, F.col("tc"))
    rich = cover / F.greatest(F.lit(0.005), F.col("interior") / F.greatest(one, F.col("ti")))
    raw = F.col("count") * 10 + F.col("contact") * 4 + rich * 3 + touch * 10
    apart = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("separation") - F.col("limit")) / 0.12))
    score = F.round(raw * F.when(F.col("family"), F.lit(0.12) + apart * 0.33).otherwise(1.0), 6)
    unit = lambda v: F.least(F.lit(1.0), v)
    conf = F.round(unit(unit(cover / 0.08) * 0.38 + unit(touch / 0.08) * 0.27 + unit(F.sqrt(F.greatest(F.lit(0.0), rich - 1)) / 2) * 0.25 + unit(F.col("separation") / 0.16) * 0.1), 6)
    whole = F.greatest(one, F.col("count") + F.col("interior"))
    support = F.col("n3") / F.greatest(one, F.col("count") + F.col("n2"))
    first, low = F.col("count") / whole, F.lit(1.0) - unit(support)
    i1, i2 = F.col("inner1") / F.col("count"), F.col("inner2") / F.col("count")
    fringe = F.round(F.greatest(first * F.greatest(i1, i2) * low, first * low * F.greatest(F.lit(0.0), (F.lit(0.22) - F.col("separation")) / 0.22)), 6)
    six = lambda v: F.round(v, 6)
    e = e.withColumns({"score": score, "confidence": conf, "fringe": fringe, "distance1": six(first), "distance2": six(F.col("n2") / whole), "distance3": six(F.col("n3") / whole), "support": six(support), "darker1": six(i1), "darker2": six(i2)})
    e = e.withColumn("repair_score", six(F.col("score") * (F.lit(1.0) - F.least(F.lit(0.95), F.col("fringe"))))).withColumn("separation", six(F.col("separation")))
    e = e.withColumn("label", F.when(F.col("confidence") >= 0.8, "deliberate").when(F.col("confidence") >= 0.55, "partial").otherwise("weak"))
    return top_k(e, ["asset_id"], [F.desc("repair_score"), F.desc("score"), F.desc("count"), F.desc("contact"), "color"], k).select("asset_id", "rank", "color", *EVIDENCE)
