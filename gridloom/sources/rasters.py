"""Raw RGBA rasters to pixel rows and back, palette strips and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIP_PIXELS = 1 << 20


def explode_rasters(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``images(asset_id, width, height, content)`` -> (pixels, errors).

    A raster whose byte count is not ``width * height * 4`` becomes an error row.  Each image
    is first cut into rows, so a pixel row never drags the whole raster along.
    """
    want = F.col("width") * F.col("height") * 4
    good = F.length("content") == want
    errors = images.filter(~F.coalesce(good, F.lit(False))).select(
        "asset_id", want.cast("long").alias("expected_bytes"), F.length("content").cast("long").alias("actual_bytes"))
    rows = images.filter(good & (F.col("width") > 0) & (F.col("height") > 0)).withColumn(
        "y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height").cast("long") - 1)))
    rows = rows.select("asset_id", "y", F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"),
                       F.substring("content", F.col("y") * F.col("width") * 4 + 1, F.col("width") * 4).alias("line"))
    px = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)))
    v = F.conv(F.hex(F.substring("line", (F.col("x") * 4 + 1).cast("int"), F.lit(4))), 16, 10).cast("long")
    px = px.withColumn("v", v)
    part = lambda n: F.shiftright("v", n).bitwiseAND(255)
    return px.select("asset_id", (F.col("y") * F.col("w") + F.col("x")).alias("idx"), "x", "y", "w", "h", part(24).alias("r"),
                     part(16).alias("g"), part(8).alias("b"), part(0).alias("a")), errors


def assemble_rasters(px: DataFrame, strip_pixels: int = STRIP_PIXELS) -> DataFrame:
    """Pixel rows to ordered raw strips of whole image rows, at most about ``strip_pixels`` each.

    Small images come out as strip 0 alone; a huge one as several strips that concatenate to
    its raster, so no task holds more than one strip.
    """
    rows = F.greatest(F.lit(1), F.floor(F.lit(strip_pixels) / F.col("w")))
    d = px.withColumn("strip", F.floor(F.col("y") / rows))
    byte = lambda c: F.lpad(F.hex(F.col(c)), 2, "0")
    entry = F.struct("idx", F.concat(*[byte(c) for c in "rgba"]).alias("hex"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["hex"]), "")
    return d.groupBy("asset_id", "strip").agg(F.max("w").alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.unhex(joined).alias("content"))


def palette_from_strip(px: DataFrame) -> DataFrame:
    """Distinct colours of pixels with any alpha, in first-seen order."""
    from gridloom.functions.color import pack
    from gridloom.operators.ordering import rank_in_chunks

    c = px.filter("a > 0").groupBy("asset_id", pack(F.col("r"), F.col("g"), F.col("b")).alias("color")).agg(F.min("idx").alias("first_idx"))
    c = c.withColumn("chunk", F.floor(F.col("first_idx") / 4096))
    return rank_in_chunks(c, ["asset_id"], ["chunk"], ["first_idx"], "pos").select("asset_id", (F.col("pos") - 1).alias("pos"), "color")


def palette_strip(pal: DataFrame, swatch: int = 1) -> DataFrame:
    """Paint ``swatch`` x ``swatch`` squares, one per palette entry."""
    from gridloom.functions.color import rgb

    seq = F.sequence(F.lit(0).cast("long"), F.lit(swatch - 1).cast("long"))
    n = pal.groupBy("asset_id").agg((F.count(F.lit(1)) * swatch).alias("w"))
    d = pal.join(n, "asset_id").withColumn("y", F.explode(seq)).withColumn("dx", F.explode(seq))
    r, g, b = rgb(F.col("color"))
    x = F.col("pos") * swatch + F.col("dx")
    return d.select("asset_id", (F.col("y") * F.col("w") + x).alias("idx"), x.alias("x"), "y", "w", F.lit(swatch).cast("long").alias("h"),
                    r.alias("r"), g.alias("g"), b.alias("b"), F.lit(255).cast("long").alias("a"))


def asset_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("asset_id"), F.lit(buckets)).cast("int")


SLICE_ROWS = 1 << 20


def write_results(df: DataFrame, path: str, overwrite: bool = False, buckets: int = 64, fmt: str = "parquet") -> None:
    """Write per-asset results in ``asset_bucket`` folders; refuse to replace a folder unless asked.

    The rows are dealt by (bucket, slice), so a bucket has one file per slice and a very large
    asset is written by several tasks.
    """
    part = F.floor(F.col("idx") / SLICE_ROWS) if "idx" in df.columns else F.lit(0)
    d = df.withColumn("asset_bucket", asset_bucket(buckets)).repartition("asset_bucket", part)
    d.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("asset_bucket").format(fmt).save(path)


def synth_pixels(native: DataFrame, scale: int, phase_x: int = 0, phase_y: int = 0) -> DataFrame:
    """Up-scale native art to fake pixels at ``scale`` and phase, with a small fixed wobble on red."""
    n = F.sequence(F.lit(0).cast("long"), F.lit(scale - 1).cast("long"))
    d = native.withColumn("dy", F.explode(n)).withColumn("dx", F.explode(n))
    x, y = F.col("x") * scale + F.col("dx") + phase_x, F.col("y") * scale + F.col("dy") + phase_y
    w, h = F.col("w") * scale + phase_x, F.col("h") * scale + phase_y
    wobble = F.when((F.col("a") > 0) & ((x * 3 + y * 5) % 17 == 0), F.least(F.lit(255), F.col("r") + 1)).otherwise(F.col("r"))
    return d.select("asset_id", (y * w + x).alias("idx"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), wobble.cast("long").alias("r"), "g", "b", "a")
