"""Connected components, border flood fill and distance from the exterior.

Vertices are horizontal runs, edges join runs of neighbouring rows, and all assets are
solved together.  Each round hooks every root to its least neighbour and contracts the
edge set, which shrinks fast; both tables are checkpointed once per round.  All of them grow
with the pixels, so they meet by merge joins: a broadcast a round, kept until the driver collects
it, filled the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators.stencil import column_window, row_window
from gridloom.session import cut_lineage


def with_runs(px: DataFrame, key: Column) -> DataFrame:
    """Adds ``key`` and ``run``, the pixel index of the first pixel of its horizontal run."""
    d = px.withColumn("key", key)
    start = F.when(F.lag("key").over(row_window()).eqNullSafe(F.col("key")), None).otherwise(F.col("idx"))
    d = d.withColumn("__s", start)
    return d.withColumn("run", F.last("__s", ignorenulls=True).over(row_window().rowsBetween(W.unboundedPreceding, 0))).drop("__s")


def _edges(runs: DataFrame, connectivity: int) -> DataFrame:
    """Distinct (u, v) run pairs of touching rows with equal keys; linear in the pixels."""
    v = F.struct("key", "run")
    if connectivity == 4:
        up = F.array(F.lag(v).over(column_window()))
        d = runs.withColumn("up", up)
    else:
        d = runs.withColumn("three", F.array(F.lag(v).over(row_window()), v, F.lead(v).over(row_window())))
        d = d.withColumn("up", F.lag("three").over(column_window()))
    d = d.filter(F.col("key").isNotNull()).select("asset_id", "key", "run", F.explode("up").alias("o")).filter(F.col("o.key") == F.col("key"))
    return d.select("asset_id", F.col("run").alias("u"), F.col("o.run").alias("v")).filter("u <> v").distinct()


def connect(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices(asset_id, v)`` -> ``root``: least vertex of the component, by contraction."""
    parent = cut_lineage(vertices.select("asset_id", "v", F.col("v").alias("root")))
    e = cut_lineage(edges.select("asset_id", "u", "v"))
    while not e.isEmpty():  # every round removes at least one root per open component
        both = e.unionByName(e.select("asset_id", F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("asset_id", "u").agg(F.min("v").alias("m")).select("asset_id", "u", F.least("u", "m").alias("m"))
        nxt = hook.select("asset_id", F.col("u").alias("m"), F.col("m").alias("m2"))
        hook = hook.join(nxt.hint("merge"), ["asset_id", "m"], "left").select("asset_id", "u", F.coalesce("m2", "m").alias("m"))
        nxt = hook.select("asset_id", F.col("u").alias("m"), F.col("m").alias("m2"))
        hook = cut_lineage(hook.join(nxt.hint("merge"), ["asset_id", "m"], "left").select("asset_id", "u", F.coalesce("m2", "m").alias("m")))
        to = hook.select("asset_id", F.col("u").alias("root"), F.col("m").alias("nr"))
        parent = cut_lineage(parent.join(to.hint("merge"), ["asset_id", "root"], "left").select("asset_id", "v", F.coalesce("nr", "root").alias("root")))
        a = hook.select("asset_id", "u", F.col("m").alias("mu"))
        b = hook.select("asset_id", F.col("u").alias("v"), F.col("m").alias("mv"))
        e = cut_lineage(e.join(a.hint("merge"), ["asset_id", "u"]).join(b.hint("merge"), ["asset_id", "v"]).select(
            "asset_id", F.col("mu").alias("u"), F.col("mv").alias("v")).filter("u <> v").distinct())
    return parent


def components(px: DataFrame, key: Column, connectivity: int = 4) -> DataFrame:
    """Pixels with a non-null ``key`` and their component id (its least pixel index).

    Equal keys connect through 4 or 8 neighbours.
    """
    runs = with_runs(px, key)
    vertices = runs.filter(F.col("key").isNotNull()).groupBy("asset_id", F.col("run").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    root = connect(vertices, _edges(runs, connectivity)).select("asset_id", F.col("v").alias("run"), F.col("root").alias("component"))
    return runs.filter(F.col("key").isNotNull()).join(root.hint("merge"), ["asset_id", "run"]).drop("run")


def component_stats(labelled: DataFrame) -> DataFrame:
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("w") - 1) | (F.col("y") == F.col("h") - 1)
    return labelled.groupBy("asset_id", "component", "key").agg(F.count(F.lit(1)).alias("size"), F.max(edge).alias("touches_edge"))


def exterior(px: DataFrame, match: Column) -> DataFrame:
    """Keys ``(asset_id, idx)`` of matching pixels joined to the border through matching pixels."""
    lab = components(px, F.when(match, F.lit(1)))
    out = component_stats(lab).filter("touches_edge").select("asset_id", "component")
    return lab.join(out.hint("merge"), ["asset_id", "component"], "left_semi").select("asset_id", "idx")


def flood_fill(px: DataFrame, model: DataFrame, tolerance: int = 18, threshold: int = 128) -> DataFrame:
    """Clear background-coloured pixels reachable from the border, then binarise alpha.

    ``model(asset_id, first, second)`` holds one or two packed background colours.
    """
    from gridloom.functions import color as C

    j = px.join(model.select("asset_id", "first", "second").hint("shuffle_hash"), "asset_id")
    rgb = tuple(F.col(c) for c in "rgb")
    near = lambda c: C.distance_sq(rgb, C.rgb(F.col(c))) <= 3 * tolerance * tolerance
    match = near("first") | F.coalesce(near("second"), F.lit(False))
    outside = exterior(j, match).withColumn("out", F.lit(True))
    gone = px.join(outside.hint("merge"), ["asset_id", "idx"], "left")
    return gone.withColumn("a", F.when(F.col("out"), 0).when(F.col("a") >= threshold, 255).otherwise(0).cast("long")).drop("out")


def exterior_depth(px: DataFrame, outside: DataFrame) -> DataFrame:
    """Depth 0 outside, then 1 and 2 by 4-neighbour steps, 3 for everything deeper."""
    m = px.select("asset_id", "idx", "x", "y", "w", "h").join(outside.withColumn("o", F.lit(1)), ["asset_id", "idx"], "left")
    d = m.withColumn("depth", F.when(F.col("o") == 1, 0)).drop("o")
    for level in (1, 2):
        near = lambda w: F.greatest(F.coalesce((F.lag("depth").over(w) == level - 1).cast("int"), F.lit(0)),
                                    F.coalesce((F.lead("depth").over(w) == level - 1).cast("int"), F.lit(0)))
        d = d.withColumn("__h", near(row_window())).withColumn("__v", near(column_window()))
        d = d.withColumn("depth", F.coalesce("depth", F.when((F.col("__h") == 1) | (F.col("__v") == 1), level))).drop("__h", "__v")
    return d.select("asset_id", "idx", F.coalesce("depth", F.lit(3)).cast("long").alias("depth"))


def area_histogram(px: DataFrame, min_region: int = 1) -> DataFrame:
    """Colour weights as the sum of squared region sizes; raw counts where no region is large enough."""
    from gridloom.functions import color as C

    vis = F.when(F.col("a") >= 16, C.pack(F.col("r"), F.col("g"), F.col("b")))
    st = components(px, vis).groupBy("asset_id", "component", F.col("key").alias("color")).agg(F.count(F.lit(1)).alias("size"), F.min("idx").alias("first_idx"))
    big = F.col("size") >= min_region
    g = st.groupBy("asset_id", "color").agg(
        F.sum(F.when(big, F.col("size") * F.col("size"))).alias("area"), F.sum("size").alias("raw"),
        F.min(F.when(big, F.col("first_idx"))).alias("area_first"), F.min("first_idx").alias("raw_first"))
    any_big = g.groupBy("asset_id").agg((F.count("area") > 0).alias("any_big"))
    return g.join(any_big, "asset_id").filter(~F.col("any_big") | F.col("area").isNotNull()).select(
        "asset_id", "color", F.when(F.col("any_big"), F.col("area")).otherwise(F.col("raw")).alias("n"),
        F.when(F.col("any_big"), F.col("area_first")).otherwise(F.col("raw_first")).alias("first_idx"))
