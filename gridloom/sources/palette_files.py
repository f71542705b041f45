"""Text palettes (hex list, GIMP, JASC), palette JSON and the bundled palette table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.color import hex_of

HEX6 = r"^#?[0-9a-fA-F]{6}$"
DECIMAL_LINE = r"^(\d{1,3})\s+(\d{1,3})\s+(\d{1,3})(?:\s+.*)?$"

# Bundled palettes, the presets, and other names of the same palettes.
BUNDLED = {
    "pico8": ("#000000 #1d2b53 #7e2553 #008751 #ab5236 #5f574f #c2c3c7 #fff1e8 "
              "#ff004d #ffa300 #ffec27 #00e436 #29adff #83769c #ff77a8 #ffccaa"),
    "db16": ("#140c1c #442434 #30346d #4e4a4e #854c30 #346524 #d04648 #757161 "
             "#597dce #d27d2c #8595a1 #6daa2c #d2aa99 #6dc2ca #dad45e #deeed6"),
    "gameboy": "#0f380f #306230 #8bac0f #9bbc0f",
    "cga16": ("#000000 #0000aa #00aa00 #00aaaa #aa0000 #aa00aa #aa5500 #aaaaaa "
              "#555555 #5555ff #55ff55 #55ffff #ff5555 #ff55ff #ffff55 #ffffff"),
    "mono4": "#0f172a #475569 #cbd5e1 #f8fafc",
    "arcade8": "#101112 #2f3742 #48636f #5c8d78 #9bb66f #d6c86e #d98b5f #f4efe4",
    "ui8": "#0b0f19 #1f2937 #374151 #6b7280 #d1d5db #f9fafb #60a5fa #f97316",
}
ALIASES = {"dawnbringer16": "db16", "dmg": "gameboy", "gb": "gameboy"}


def read_palette_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole small text files as ``(palette_id, text)``; the id is the file name."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("palette_id"), F.col("value").alias("text"))


def _lines(texts: DataFrame) -> DataFrame:
    d = texts.select("palette_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "raw"))
    return d.withColumn("line", F.trim("raw"))


def _ranked(d: DataFrame, color: Column) -> DataFrame:
    from gridloom.operators.ordering import rank_in_chunks

    c = d.select("palette_id", "line_no", color.alias("color")).withColumn("chunk", F.floor(F.col("line_no") / 1024))
    return rank_in_chunks(c, ["palette_id"], ["chunk"], ["line_no"], "pos").select("palette_id", (F.col("pos") - 1).alias("pos"), "color")


def parse_hex(texts: DataFrame) -> DataFrame:
    """First token of each line that is six hex digits; ``//`` and ``;`` start comments."""
    d = _lines(texts).withColumn("token", F.split("line", r"\s+")[0])
    d = d.filter((F.length("line") > 0) & ~F.col("line").startswith("//") & ~F.col("line").startswith(";") & F.col("token").rlike(HEX6))
    return _ranked(d, F.concat(F.lit("#"), F.lower(F.regexp_replace("token", "^#", ""))))


def _decimal(d: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("line", DECIMAL_LINE, i).cast("long")
    d = d.filter(F.col("line").rlike(DECIMAL_LINE)).withColumn("r", part(1)).withColumn("g", part(2)).withColumn("b", part(3))
    d = d.filter((F.col("r") <= 255) & (F.col("g") <= 255) & (F.col("b") <= 255))
    return _ranked(d, hex_of(F.col("r") * 65536 + F.col("g") * 256 + F.col("b")))


def parse_gimp(texts: DataFrame) -> DataFrame:
    d = _lines(texts)
    head = (F.col("line") == "GIMP Palette") | F.col("line").rlike("^(Name:|Columns:|#)")
    return _decimal(d.filter(~head))


def parse_jasc(texts: DataFrame) -> DataFrame:
    """Skips the three header lines after a ``JASC-PAL`` first line, and comments."""
    d = _lines(texts)
    head = d.filter(F.length("line") > 0).groupBy("palette_id").agg(F.min(F.struct("line_no", F.upper("line").alias("up"))).alias("first"))
    start = head.select("palette_id", F.when(F.col("first.up") == "JASC-PAL", F.col("first.line_no") + 3).otherwise(0).alias("start"))
    d = d.join(start, "palette_id").filter((F.col("line_no") >= F.col("start")) & ~F.col("line").rlike("^(#|//|;)"))
    return _decimal(d)


def _colors() -> Column:
    """Ordered hex colours; a palette holds at most 512 entries."""
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", "color"))), lambda e: e["color"])


def _rgb_text(c: Column, width: int) -> Column:
    parts = [F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10) for i in range(3)]
    return F.concat_ws(" ", *[F.lpad(p, width, " ") if width else p for p in parts])


def write_texts(pal: DataFrame, app: str = "gridloom", swatch: int = 1) -> DataFrame:
    """One row per palette with its hex, GIMP, JASC, JSON and conditioning texts."""
    d = pal.groupBy("palette_id").agg(_colors().alias("c"))
    body = lambda f: F.concat(F.array_join(F.transform("c", f), "\n"), F.lit("\n"))
    n = F.size("c").cast("long")
    return d.select(
        "palette_id", F.when(n > 0, body(lambda c: c)).otherwise("").alias("hex_text"),
        F.concat(F.lit("GIMP Palette\nName: "), F.col("palette_id").cast("string"), F.lit("\nColumns: 8\n#\n"),
                 body(lambda c: F.concat(_rgb_text(c, 3), F.lit(" "), c))).alias("gimp_text"),
        F.concat(F.lit("JASC-PAL\n0100\n"), n.cast("string"), F.lit("\n"), body(lambda c: _rgb_text(c, 0))).alias("jasc_text"),
        F.to_json(F.struct(F.lit(app).alias("app"), n.alias("colorCount"), F.col("c").alias("colors"))).alias("json_text"),
        F.to_json(F.struct(F.lit("palette-conditioning/v1").alias("schema"), n.alias("colorCount"), F.col("c").alias("colors"),
                           F.struct((n * swatch).alias("width"), F.when(n > 0, F.lit(swatch)).otherwise(0).cast("long").alias("height"),
                                    F.lit(swatch).cast("long").alias("swatchSize")).alias("strip"))).alias("conditioning_text"))


def palette_name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def bundled(spark: SparkSession) -> DataFrame:
    """The bundled palettes: a fixed table of a few dozen rows."""
    names = {**{n: n for n in BUNDLED}, **ALIASES}
    rows = [(name, i, color) for name, key in names.items() for i, color in enumerate(BUNDLED[key].split())]
    return spark.createDataFrame(rows, "name_key string, pos bigint, color string")


def resolve_names(names: DataFrame, spark: SparkSession) -> DataFrame:
    """``names(palette_id, name)`` -> colours.  The dimension is fixed in code, so it is broadcast."""
    d = names.withColumn("name_key", palette_name_key(F.col("name")))
    return d.join(F.broadcast(bundled(spark)), "name_key").select("palette_id", "pos", "color")
