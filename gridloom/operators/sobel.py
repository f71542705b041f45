"""Scale votes from Sobel edges of the busiest tiles.

The gradient is separable: sums of three pixels along one direction (a window per image line), then
differences along the other. Luminance is kept as an integer (weighted by alpha), so every sum is
exact; only ratios of sums decide. After the profiles, an asset is one number per image line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators.ordering import top_k
from gridloom.operators.stencil import column_window, row_window
from gridloom.session import cut_lineage

# Fixed values of the voting rule.
MAX_SCALE, TILES, TILE_SHARE, PEAK_SHARE, PEAK_GAP, MULTIPLES = 32, 24, 0.18, 0.28, 2, 4
VOTE_FLOOR = 0.08


def luminance() -> Column:
    weighted = F.shiftright(F.col("r") * 77 + F.col("g") * 150 + F.col("b") * 29, 8)
    return F.when(F.col("a") > 8, weighted * F.col("a")).otherwise(0)


def gradients(px: DataFrame) -> DataFrame:
    """``gx, gy`` of inner pixels: absolute 3x3 Sobel responses."""
    def three(c: str, w) -> Column:
        return F.lag(c).over(w) + F.col(c) * 2 + F.lead(c).over(w)

    def step(c: str, w) -> Column:
        return F.abs(F.lead(c).over(w) - F.lag(c).over(w))

    across, down = row_window(), column_window()
    d = px.select("asset_id", "x", "y", "w", "h", luminance().alias("l"))
    d = d.withColumns({"hs": three("l", across), "vs": three("l", down)})
    return d.withColumns({"gx": step("vs", across), "gy": step("hs", down)}).where("gx IS NOT NULL AND gy IS NOT NULL").select("asset_id", "x", "y", "w", "h", "gx", "gy")


def tile_scores(grads: DataFrame, max_scale: int = MAX_SCALE) -> DataFrame:
    """Edge energy of every tile (last row and column of a tile left out) with its rank; tiles below a share of the best, or beyond the first 24, are not chosen."""
    scale = F.least(F.lit(max_scale), F.col("w"), F.col("h"))
    d = grads.withColumn("size", F.greatest(F.lit(16), F.least(F.lit(64), F.greatest(scale * 3, F.lit(24)))))
    d = d.withColumn("tx", F.floor(F.col("x") / F.col("size"))).withColumn("ty", F.floor(F.col("y") / F.col("size")))
    d = d.where((F.col("x") < F.least(F.col("w"), (F.col("tx") + 1) * F.col("size")) - 1) & (F.col("y") < F.least(F.col("h"), (F.col("ty") + 1) * F.col("size")) - 1))
    tiles = d.groupBy("asset_id", "size", "tx", "ty").agg(F.sum(F.col("gx") + F.col("gy")).alias("score")).where("score > 0")
    ranked = top_k(tiles, ["asset_id"], [F.desc("score"), "ty", "tx"], TILES)
    # at most 24 rows an asset; a join would work the gradients out twice
    best = F.max("score").over(W.partitionBy("asset_id"))
    return ranked.withColumn("best", best).where(F.col("score") >= F.col("best") * F.lit(TILE_SHARE)).select("asset_id", "size", "tx", "ty", "score", "rank")


def profiles(grads: DataFrame, tiles: DataFrame) -> DataFrame:
    """``asset_id, axis, pos, energy, size``: gradients of the chosen tiles summed per image line; lines without energy are left out."""
    chosen = tiles.select("asset_id", F.col("size").alias("ts"), "tx", "ty")
    size = chosen.select("asset_id", "ts").distinct()
    # A tile is met by its place; an asset's pixels are dealt over its tiles.
    d = grads.join(size, "asset_id").withColumn("tx", F.floor(F.col("x") / F.col("ts"))).withColumn("ty", F.floor(F.col("y") / F.col("ts"))).join(chosen, ["asset_id", "ts", "tx", "ty"], "left_semi")
    d = d.where((F.col("x") < F.least(F.col("w"), (F.col("tx") + 1) * F.col("ts")) - 1) & (F.col("y") < F.least(F.col("h"), (F.col("ty") + 1) * F.col("ts")) - 1))
    line = lambda axis, pos, g, n: F.struct(F.lit(axis).alias("axis"), F.col(pos).alias("pos"), F.col(g).alias("g"), F.col(n).alias("n"))
    both = d.select("asset_id", F.explode(F.array(line("x", "x", "gx", "w"), line("y", "y", "gy", "h"))).alias("l"))
    return both.groupBy("asset_id", F.col("l.axis").alias("axis"), F.col("l.pos").alias("pos")).agg(F.sum("l.g").alias("energy"), F.max("l.n").alias("size")).where("energy > 0")


def peaks(prof: DataFrame) -> DataFrame:
    """``asset_id, axis, pos``: local maxima above a share of the strongest line; of peaks at most two lines apart the higher stays.

    The peaks of one axis are folded in line order inside their row: at most one for every second line.
    """
    w = W.partitionBy("asset_id", "axis").orderBy("pos")
    at = lambda side, step: F.when(side("pos").over(w) == F.col("pos") + step, side("energy").over(w)).otherwise(0)
    top = prof.groupBy("asset_id", "axis").agg(F.max("energy").alias("top"))
    d = prof.withColumns({"lo": at(F.lag, -1), "hi": at(F.lead, 1)}).join(top, ["asset_id", "axis"])
    d = d.where((F.col("energy") >= F.col("top") * F.lit(PEAK_SHARE)) & (F.col("energy") >= F.col("lo")) & (F.col("energy") >= F.col("hi")) & (F.col("pos") >= 1) & (F.col("pos") < F.col("size") - 1))
    seq = F.array_sort(F.collect_list(F.struct("pos", "energy")))

    def keep(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        close = (F.size(acc) > 0) & (p["pos"] - F.when(F.size(acc) > 0, last["pos"]) <= PEAK_GAP)
        swapped = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(p))
        return F.when(~F.coalesce(close, F.lit(False)), F.concat(acc, F.array(p))).when(p["energy"] > last["energy"], swapped).otherwise(acc)

    kept = d.groupBy("asset_id", "axis").agg(F.aggregate(seq, F.array().cast("array<struct<pos:bigint,energy:bigint>>"), keep).alias("kept"))
    return kept.select("asset_id", "axis", F.explode("kept").alias("p")).select("asset_id", "axis", F.col("p.pos").alias("pos"))


def sobel_votes(px: DataFrame, max_scale: int = MAX_SCALE) -> DataFrame:
    """``asset_id, scale, vote, votes, phase_x, phase_y, best_vote, top_scale``: scales that edges of the busiest tiles speak for.

    A scale gets votes from peak distances near its first four multiples, and a phase score from the
    share and density of edges on its lattice. Ready for ``grid_candidates(votes=...)``.
    """
    grads = gradients(px)
    sizes = px.groupBy("asset_id").agg(F.least(F.lit(max_scale), F.max("w"), F.max("h")).cast("long").alias("limit")).where("limit >= 2")
    # tiles and profiles are small and read many times: written once, or each reader repeats the gradients
    prof = cut_lineage(profiles(grads, cut_lineage(tile_scores(grads, max_scale))))
    pk = peaks(prof)
    gap = F.col("pos") - F.lag("pos").over(W.partitionBy("asset_id", "axis").orderBy("pos"))
    near = pk.withColumn("gap", gap).where("gap >= 2").join(sizes, "asset_id").where(F.col("gap") <= F.col("limit") * 4)
    near = near.withColumn("scale", F.explode(F.sequence(F.lit(2).cast("long"), F.col("limit"))))
    times = F.greatest(F.lit(1), F.floor(F.col("gap") / F.col("scale") + F.lit(0.5)))
    tol = F.greatest(F.lit(1.0), F.col("scale") * F.lit(0.2))
    near = near.withColumn("times", times).withColumn("miss", F.abs(F.col("gap") - F.col("times") * F.col("scale"))).where((F.col("times") <= MULTIPLES) & (F.col("miss") <= tol))
    votes = near.groupBy("asset_id", "scale").agg(F.round(F.sum((F.lit(1.0) - F.col("miss") / (tol + 1.0)) / F.col("times")), 9).alias("votes"))
    most = votes.groupBy("asset_id").agg(F.max("votes").alias("most"))

    total = prof.groupBy("asset_id", "axis").agg(F.sum("energy").alias("total"), F.max("energy").alias("top"))
    lines = prof.join(sizes, "asset_id").withColumn("scale", F.explode(F.sequence(F.lit(2).cast("long"), F.col("limit")))).where(F.col("pos") >= F.col("scale"))
    ph = lines.groupBy("asset_id", "axis", "scale", (F.col("pos") % F.col("scale")).alias("phase")).agg(F.sum("energy").alias("energy"), F.max("size").alias("size")).join(total, ["asset_id", "axis"])
    count = F.floor((F.col("size") - 1 - F.col("phase")) / F.col("scale"))
    conf = F.col("energy") / F.col("total") * F.lit(0.72) + F.sqrt(F.col("energy") / count / F.col("top")) * F.lit(0.28)
    best = ph.withColumn("conf", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)), 9)).groupBy("asset_id", "axis", "scale").agg(F.max_by(F.struct("phase", "conf"), F.struct("conf", -F.col("phase"))).alias("b"))
    pick = lambda axis, c: F.max(F.when(F.col("axis") == axis, F.col(f"b.{c}")))
    both = best.groupBy("asset_id", "scale").agg(*[F.coalesce(pick(a, c), F.lit(0)).alias(f"{c}_{a}") for a in "xy" for c in ("phase", "conf")])
    d = both.join(votes, ["asset_id", "scale"], "full").join(most, "asset_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = F.when(zero("most") > 0, zero("votes") / F.col("most")).otherwise(F.lit(0.0))
    score = F.round(F.least(F.lit(1.0), (zero("conf_x") + zero("conf_y")) / 2.0 * F.lit(0.62) + share * F.lit(0.38)), 9)
    d = d.withColumn("vote", score).where(F.col("vote") > VOTE_FLOOR)
    shift = lambda a: ((F.coalesce(f"phase_{a}", F.lit(0)) + 1) % F.col("scale")).cast("long").alias(f"phase_{a}")
    d = d.select("asset_id", "scale", "vote", zero("votes").alias("votes"), shift("x"), shift("y"), F.round(share, 3).alias("share"))
    # Published scores have three places, and these decide the first scale.
    first = d.groupBy("asset_id").agg(F.max("vote").alias("best_vote"), F.max_by("scale", F.struct(F.round("vote", 3), "share", "scale")).alias("top_scale"))
    return d.drop("share").join(first, "asset_id")


def votes_for_grid(px: DataFrame, max_scale: int = MAX_SCALE) -> DataFrame:
    """Votes of images with a side of at least 64 pixels; smaller ones go without."""
    return sobel_votes(px.where((F.col("w") >= 64) | (F.col("h") >= 64)), max_scale)
