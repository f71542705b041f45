"""Raster, frame and palette collections derived from the driver tables.

All are narrow projections of a scan times a fixed-size coordinate table.  Only the seed rows are
dealt out, by asset, so that the pixels of a raster meet without another shuffle.  ``w`` and ``h`` ride
on every pixel row: a constant column costs nothing in Parquet and saves a join to ``images``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.ordering import rank_in_chunks
from gridloom.sources.tables import table

PIXEL_COLUMNS = ["asset_id", "idx", "x", "y", "w", "h", "r", "g", "b", "a"]


def _div(a: Column, b: Column | int) -> Column:
    return F.floor(a / (F.lit(b) if isinstance(b, int) else b)).cast("long")


#: Pixels of one partition, about.
PART_PIXELS = 1 << 20


def _spread(df: DataFrame) -> DataFrame:
    """Deal the few rows of a fixed small table over all cores before each becomes many pixels.

    Round robin on purpose: these rasters are few and large.
    """
    return df.repartition(max(8, df.sparkSession.sparkContext.defaultParallelism))


def _by_asset(df: DataFrame, pixels: int) -> DataFrame:
    """Deal seed rows by ``asset_id`` before each becomes ``pixels`` pixels, a small fixed number.

    Groups, windows and joins that start with the asset find their pixels in place. The number of
    partitions follows the rows, so that a task holds about ``PART_PIXELS`` at any size.
    """
    parts = -(-df.count() * pixels // PART_PIXELS)
    return df.repartition(max(8, df.sparkSession.sparkContext.defaultParallelism, parts), "asset_id")


def _times(df: DataFrame, name: str, n: int) -> DataFrame:
    """Each row once for every ``name`` below ``n``.

    A join with a range and not an ``explode``: Spark takes exploded rows to be no larger than the
    seeds, and would send millions of pixels through the driver as a small table.
    """
    return df.crossJoin(F.broadcast(df.sparkSession.range(n).withColumnRenamed("id", name)))


def _grid(df: DataFrame, side: int) -> DataFrame:
    return (
        _times(_by_asset(df, side * side), "idx", side * side)
        .withColumn("x", F.col("idx") % side)
        .withColumn("y", F.shiftright("idx", side.bit_length() - 1) if side & (side - 1) == 0
                    else _div(F.col("idx"), side))
        .withColumn("w", F.lit(side).cast("long"))
        .withColumn("h", F.lit(side).cast("long"))
    )


def px_part(spark: SparkSession, sf_dir: str, with_scale: bool = False) -> DataFrame:
    """Up-scaled fake pixel art with a known block size ``s`` (24x24 per part)."""
    base = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("asset_id"), (F.col("p_size") % 4 + 2).cast("long").alias("s")
    )
    px = _grid(base, 24).withColumn("cx", _div(F.col("x"), F.col("s"))).withColumn("cy", _div(F.col("y"), F.col("s")))
    px = px.withColumn("hh", (F.col("asset_id") * 31 + F.col("cx") * 7 + F.col("cy") * 13 + F.col("cx") * F.col("cy")) % 11)
    last = _div(F.lit(23).cast("long"), F.col("s"))
    ring = (F.col("cx") == 0) | (F.col("cy") == 0) | (F.col("cx") == last) | (F.col("cy") == last)
    noise = F.when((F.col("x") * 3 + F.col("y") * 5 + F.col("asset_id")) % 17 == 0, 1).otherwise(0)
    px = (
        px.withColumn("r", (F.col("hh") * 47 + 23) % 256 + noise)
        .withColumn("g", (F.col("hh") * 83 + 71) % 256)
        .withColumn("b", (F.col("hh") * 131 + 113) % 256)
        .withColumn("a", F.when(ring | (F.col("hh") == 0), 0).when(F.col("hh") == 1, 128).otherwise(255).cast("long"))
    )
    return px.select(*PIXEL_COLUMNS, *(["s"] if with_scale else []))


def px_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 opaque rasters, one per embedding."""
    e = _by_asset(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("asset_id"), "embedding"), 64).select(
        "asset_id", F.posexplode("embedding").alias("pos", "value")
    )
    m = F.col("value").cast("double") * 1000.0
    v = F.least(F.lit(255), F.floor(m - F.floor(m / 256.0) * 256.0)).cast("long")
    idx = F.col("pos").cast("long")
    return e.withColumn("v", v).select(
        "asset_id", idx.alias("idx"), (idx % 8).alias("x"), F.shiftright(idx, 3).alias("y"),
        F.lit(8).cast("long").alias("w"), F.lit(8).cast("long").alias("h"),
        F.col("v").alias("r"), (255 - F.col("v")).alias("g"), F.shiftright("v", 1).alias("b"),
        F.lit(255).cast("long").alias("a"),
    )


def px_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16x16 opaque tilesets of 4x4-pixel tiles with a known number of tile classes."""
    px = _grid(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("asset_id")), 16)
    tx, ty = F.shiftright("x", 2), F.shiftright("y", 2)
    px = px.withColumn("k", (F.col("asset_id") * 7 + tx * 3 + ty * 5) % (F.col("asset_id") % 6 + 3))
    ix, iy = F.col("x") % 4, F.col("y") % 4
    px = (
        px.withColumn("r", (F.col("k") * 29 + ix * 11 + iy * 17) % 256)
        .withColumn("g", (F.col("k") * 53 + ix * 7) % 256)
        .withColumn("b", (F.col("k") * 97 + iy * 13) % 256)
        .withColumn("a", F.lit(255).cast("long"))
    )
    return px.select(*PIXEL_COLUMNS)


def px_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """96x64 sprite sheets, one per supplier: two row bands of three or four drifting cells."""
    base = _by_asset(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset_id")), 64 * 96)
    px = _times(_times(base, "y", 64), "x", 96)
    k, x, y = F.col("asset_id"), F.col("x"), F.col("y")
    row = F.when(y < 32, 0).otherwise(1)
    col = F.floor((x - 2) / 22)
    left = col * 22 + 4 + (k * 7 + col * 3 + row * 5) % 3
    top = row * 30 + 5
    inside = (
        (x >= 2) & (col < (k + row) % 2 + 3) & (x >= left) & (x < left + (k + col) % 4 + 13) & (y >= top) & (y < top + (k + row) % 5 + 16))
    h = (k * 31 + col * 7 + row * 13) % 11
    paint = lambda m, c: F.when(inside, (h * m + c) % 256).otherwise(0).cast("long")
    return px.select(
        "asset_id", (y * 96 + x).alias("idx"), "x", "y", F.lit(96).cast("long").alias("w"), F.lit(64).cast("long").alias("h"),
        paint(47, 23).alias("r"), paint(83, 71).alias("g"), paint(131, 113).alias("b"), F.when(inside, 255).otherwise(0).cast("long").alias("a"))


#: DuckDB statement of ``px_wide``.
PX_WIDE = """px_wide AS (
  SELECT asset_id, y*170+x AS idx, x, y, 170::BIGINT AS w, 150::BIGINT AS h,
    CASE WHEN bg THEN 240 WHEN sp THEN 226+(x*5+y*3)%13 ELSE (hh*47+23)%200 END AS r, CASE WHEN bg THEN 240 WHEN sp THEN 230+(x+y*7)%11 ELSE (hh*83+71)%200 END AS g,
    CASE WHEN bg THEN 240 WHEN sp THEN 232+(x*3+y)%13 ELSE (hh*131+113)%200 END AS b, CASE WHEN bg THEN 0 ELSE 255 END::BIGINT AS a
  FROM (SELECT *, least(x,y,169-x,149-y)<3 AS bg, least(x,y,169-x,149-y)<25+asset_id*9 AND (x*7+y*3+asset_id)%19<>0 AS sp, (asset_id*31+x//8*7+y//8*13)%11 AS hh FROM (
    SELECT r_regionkey::BIGINT AS asset_id, x, y FROM region, (SELECT range AS x FROM range(170)), (SELECT range AS y FROM range(150)))))"""


def px_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """170x150 rasters, one per region: clear rim, a spill of 22 to 58 rings with gaps in it, blocks inside."""
    zero = F.lit(0).cast("long")
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("asset_id")).withColumn("y", F.explode(F.sequence(zero, F.lit(149).cast("long"))))
    px = _spread(rows).withColumn("x", F.explode(F.sequence(zero, F.lit(169).cast("long"))))
    k, x, y = F.col("asset_id"), F.col("x"), F.col("y")
    depth = F.least(x, y, 169 - x, 149 - y)
    bg, sp, h = depth < 3, (depth < 25 + k * 9) & ((x * 7 + y * 3 + k) % 19 != 0), (k * 31 + F.shiftright(x, 3) * 7 + F.shiftright(y, 3) * 13) % 11
    paint = lambda spill, m, c: F.when(bg, 240).when(sp, spill).otherwise((h * m + c) % 200).cast("long")
    return px.select(
        "asset_id", (y * 170 + x).alias("idx"), "x", "y", F.lit(170).cast("long").alias("w"), F.lit(150).cast("long").alias("h"),
        paint(226 + (x * 5 + y * 3) % 13, 47, 23).alias("r"), paint(230 + (x + y * 7) % 11, 83, 71).alias("g"), paint(232 + (x * 3 + y) % 13, 131, 113).alias("b"), F.when(bg, 0).otherwise(255).cast("long").alias("a"))


#: DuckDB statement of ``px_backdrop``.
PX_BACKDROP = """px_backdrop AS (
  SELECT asset_id, y*64+x AS idx, x, y, 64::BIGINT AS w, 48::BIGINT AS h, CASE WHEN sub THEN 30+(x*7+y)%40 ELSE base+tint*40 END AS r, CASE WHEN sub THEN 60+(x+y*5)%50 ELSE base END AS g,
    CASE WHEN sub THEN 120+asset_id ELSE greatest(0, base-tint*60) END AS b, CASE WHEN kind=4 AND NOT sub THEN 0 ELSE 255 END::BIGINT AS a
  FROM (SELECT *, CASE kind WHEN 0 THEN 180+(x*3+y*5+asset_id)%4 WHEN 1 THEN CASE WHEN x+y<40+asset_id THEN 210 ELSE 110+(x+y)%3 END WHEN 2 THEN CASE WHEN (((x+sh)//cs)+((y+sh)//cs))%2=0 THEN 240 ELSE 204 END ELSE 130+x+y//2 END AS base,
      CASE WHEN kind<2 AND asset_id%2=0 THEN 1 ELSE 0 END AS tint, x BETWEEN 14 AND 49 AND y BETWEEN 12 AND 36 AND (x+y*2)%23<>0 OR (x BETWEEN 20 AND 24+asset_id%3 AND y>36) AS sub FROM (
    SELECT n_nationkey::BIGINT AS asset_id, x, y, n_nationkey%5 AS kind, CASE n_nationkey//5 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 16 WHEN 3 THEN 6 ELSE 12 END AS cs, n_nationkey%4 AS sh FROM nation, (SELECT range AS x FROM range(64)), (SELECT range AS y FROM range(48)))))"""


def px_backdrop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64x48 rasters, one per nation: a subject before a plain, two-coloured, chequered, graded or clear backdrop."""
    zero = F.lit(0).cast("long")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("asset_id")).withColumn("y", F.explode(F.sequence(zero, F.lit(47).cast("long"))))
    px = _spread(rows).withColumn("x", F.explode(F.sequence(zero, F.lit(63).cast("long"))))
    k, x, y = F.col("asset_id"), F.col("x"), F.col("y")
    cs = F.element_at(F.array(*[F.lit(c) for c in (4, 8, 16, 6, 12)]), (F.floor(k / 5) + 1).cast("int"))
    even = (_div(x + k % 4, cs) + _div(y + k % 4, cs)) % 2 == 0
    kind = k % 5
    base = F.when(kind == 0, 180 + (x * 3 + y * 5 + k) % 4).when(kind == 1, F.when(x + y < 40 + k, 210).otherwise(110 + (x + y) % 3)).when(kind == 2, F.when(even, 240).otherwise(204)).otherwise(130 + x + _div(y, 2))
    tint = F.when((kind < 2) & (k % 2 == 0), 1).otherwise(0)
    sub = (x.between(14, 49) & y.between(12, 36) & ((x + y * 2) % 23 != 0)) | ((x >= 20) & (x <= 24 + k % 3) & (y > 36))
    paint = lambda inner, outer: F.when(sub, inner).otherwise(outer).cast("long")
    return px.select(
        "asset_id", (y * 64 + x).alias("idx"), "x", "y", F.lit(64).cast("long").alias("w"), F.lit(48).cast("long").alias("h"), paint(30 + (x * 7 + y) % 40, base + tint * 40).alias("r"), paint(60 + (x + y * 5) % 50, base).alias("g"),
        paint(120 + k, F.greatest(F.lit(0), base - tint * 60)).alias("b"), F.when((kind == 4) & ~sub, 0).otherwise(255).cast("long").alias("a"))


#: DuckDB statement of ``px_shell``: ``kind`` 0 the final raster, 1 its source, 2 the raster before outlining.
PX_SHELL = """px_shell AS (
  SELECT asset_id, kind, y*40+x AS idx, x, y, 40::BIGINT AS w, 32::BIGINT AS h, CASE WHEN v=0 THEN 250 WHEN v=1 THEN 90+(x*3+y)%20 WHEN v=2 THEN 20 ELSE 60+(x+y*2)%90 END AS r,
    CASE WHEN v=0 THEN 250 WHEN v=1 THEN 92+(x*3+y)%20 WHEN v=2 THEN 24 ELSE 150-(x*y)%70 END AS g, CASE WHEN v=0 THEN 250 WHEN v=1 THEN 96+(x*3+y)%20 WHEN v=2 THEN 40 ELSE 40+asset_id*5 END AS b, CASE WHEN v=0 AND kind<>1 THEN 0 ELSE 255 END::BIGINT AS a
  FROM (SELECT *, CASE WHEN e>=130+asset_id THEN 0 WHEN e>=100 THEN CASE WHEN (x*7+y*3+asset_id+kind)%5=0 THEN 0 ELSE 1 END WHEN e>=75 THEN CASE WHEN kind=2 OR (x+y*2)%11=0 THEN 1 ELSE 2 END ELSE CASE WHEN (x*5+y*3)%17=0 THEN 1 ELSE 3 END END AS v FROM (
    SELECT n_nationkey::BIGINT AS asset_id, kind, x, y, (x-20)*(x-20)+(y-16)*(y-16) AS e FROM nation, (SELECT range AS kind FROM range(3)), (SELECT range AS x FROM range(40)), (SELECT range AS y FROM range(32)))))"""


def px_shell(spark: SparkSession, sf_dir: str, kind: int) -> DataFrame:
    """40x32 rasters, one per nation: a disc with an outline and grey left around it; ``kind`` as in ``PX_SHELL``."""
    zero = F.lit(0).cast("long")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("asset_id")).withColumn("y", F.explode(F.sequence(zero, F.lit(31).cast("long"))))
    px = _spread(rows).withColumn("x", F.explode(F.sequence(zero, F.lit(39).cast("long"))))
    k, x, y = F.col("asset_id"), F.col("x"), F.col("y")
    e = (x - 20) * (x - 20) + (y - 16) * (y - 16)
    rim = F.lit(1) if kind == 2 else F.when((x + y * 2) % 11 == 0, 1).otherwise(2)
    v = F.when(e >= 130 + k, 0).when(e >= 100, F.when((x * 7 + y * 3 + k + kind) % 5 == 0, 0).otherwise(1)).when(e >= 75, rim).otherwise(F.when((x * 5 + y * 3) % 17 == 0, 1).otherwise(3))
    pick = lambda a, b, c, d: F.when(v == 0, a).when(v == 1, b).when(v == 2, c).otherwise(d).cast("long")
    grey = (x * 3 + y) % 20
    return px.select(
        "asset_id", (y * 40 + x).alias("idx"), "x", "y", F.lit(40).cast("long").alias("w"), F.lit(32).cast("long").alias("h"), pick(250, 90 + grey, 20, 60 + (x + y * 2) % 90).alias("r"),
        pick(250, 92 + grey, 24, 150 - (x * y) % 70).alias("g"), pick(250, 96 + grey, 40, 40 + k * 5).alias("b"), F.when((v == 0) & F.lit(kind != 1), 0).otherwise(255).cast("long").alias("a"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sprite frames, one per order line; duplicate names occur by design.

    ``frame_idx`` is a rank inside the order.  One order may hold a large share of all
    lines, so the rank is built from counts per (order, line, part) chunk.
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("ep"),
        F.col("l_shipdate").alias("sd"),
    )
    ranked = rank_in_chunks(li, ["asset_id"], ["line", "pk"], ["sk", "q", "ep", "sd"], "frame_no")
    return ranked.select(
        "asset_id", (F.col("frame_no") - 1).alias("frame_idx"),
        F.concat(F.lit("f_"), F.col("line").cast("string")).alias("name"),
        (F.col("pk") % 17 + 16).alias("w"), (F.col("sk") % 17 + 16).alias("h"),
        (F.floor((F.col("pk") % 17 + 16) / 2) + F.col("line") % 3).cast("double").alias("pivot_x"),
        (F.col("sk") % 17 + 16 - F.col("line") % 2).cast("double").alias("pivot_y"),
        (F.col("q").cast("long") * 10 + 60).alias("duration_ms"), F.col("line"),
    )


def animations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip per order, ``f_1..f_k``; some names have no frame."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("asset_id"),
        F.concat(F.lit("clip_"), F.lower(F.substring("o_orderpriority", 3, 20))).alias("name"),
        F.transform(F.sequence(F.lit(1).cast("long"), F.col("o_custkey") % 8 + 1),
                    lambda i: F.concat(F.lit("f_"), i.cast("string"))).alias("frames"),
        (F.col("o_custkey") % 12 + 4).alias("fps"),
        (F.col("o_orderstatus") != "F").alias("loop"),
        F.when(F.col("o_orderstatus") == "O", "forward").when(F.col("o_orderstatus") == "F", "reverse")
        .otherwise("pingpong").alias("direction"),
    )


def palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five colours per region, positions by nation key."""
    n = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("long"))
    rgb = [(F.col("k") * m + c) % 256 for m, c in ((47, 23), (83, 71), (131, 113))]
    color = rgb[0] * 65536 + rgb[1] * 256 + rgb[2]
    return n.select(
        F.col("n_regionkey").cast("long").alias("palette_id"),
        F.floor(F.col("k") / 5).cast("long").alias("pos"), color.alias("color"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("session_id"), "ts", F.col("event_type").alias("event"), "value", "props"
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle events: the job key is the user, the status follows the event type."""
    e = table(spark, sf_dir, "events")
    status = (
        F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type").isin("click", "view"), "running")
        .when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    )
    return e.select("event_id", F.col("user_id").alias("job_id"), "ts", status.alias("status"),
                    (F.col("value") / 50.0).alias("progress"))
