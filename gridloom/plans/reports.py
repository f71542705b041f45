"""Signatures, comparisons, roll-ups, settings lookup and rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import color as C
from gridloom.functions import text
from gridloom.operators.ordering import top_k

CHECK_PRIME = 4294967291
SEVERITY_RANK = ("info", "warning", "error")


def golden_signature(px: DataFrame, points: tuple[tuple[int, int], ...] = ((0, 0),), limit: int | None = None) -> DataFrame:
    """Size, visible counts, sorted palette, order-free checksum and sampled pixels per asset.

    The checksum is a sum over pixels, so it is exact whatever the partitioning.
    """
    packed = C.pack(F.col("r"), F.col("g"), F.col("b"))
    base = px.groupBy("asset_id").agg(
        F.max("w").alias("width"), F.max("h").alias("height"), F.count_if(F.col("a") > 0).alias("visible"), F.count_if(F.col("a") == 0).alias("transparent"),
        F.sum(((F.col("idx") + 1) * (packed * 256 + F.col("a"))) % CHECK_PRIME).alias("checksum"),
        *[F.max(F.when((F.col("x") == x) & (F.col("y") == y), F.concat_ws(",", "r", "g", "b", "a"))).alias(f"p_{x}_{y}") for x, y in points])
    cols = px.filter("a > 0").select("asset_id", packed.alias("color")).distinct()
    top = (cols if limit is None else top_k(cols, ["asset_id"], ["color"], limit)).groupBy("asset_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("color")), C.hex_of), " ").alias("palette"))
    return base.join(top, "asset_id", "left")


def fnv_checksum(px: DataFrame) -> DataFrame:
    """Byte-order FNV-1a per raster row, folded over the rows of the raster.

    Rows are hashed apart, then the (bounded) list of row hashes is folded, so the value is
    order-exact without one task reading all pixels.
    """
    def fold(values: Column) -> Column:
        return F.aggregate(values, F.lit(2166136261).cast("long"), lambda h, v: (h.bitwiseXOR(v) * 16777619).bitwiseAND(0xFFFFFFFF))

    seq = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("x", F.array("r", "g", "b", "a").alias("v")))), lambda e: e["v"]))
    rows = px.groupBy("asset_id", "y").agg(seq.alias("seq")).select("asset_id", "y", fold(F.col("seq")).alias("h"))
    g = rows.groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "h"))), lambda e: e["h"]).alias("hs"))
    return g.select("asset_id", fold(F.col("hs")).alias("checksum"))


def compare_tables(expected: DataFrame, actual: DataFrame, fields: list[str]) -> DataFrame:
    """Field-by-field differences of two keyed tables, missing rows included."""
    e = expected.select("asset_id", *[F.col(f).cast("string").alias(f"e_{f}") for f in fields])
    a = actual.select("asset_id", *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    j = e.join(a, "asset_id", "full_outer")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"e_{f}").alias("expected"), F.col(f"a_{f}").alias("actual")) for f in fields])
    return j.select("asset_id", F.explode(rows).alias("d")).select("asset_id", "d.*").filter(~F.col("expected").eqNullSafe(F.col("actual")))


def check_budgets(budgets: DataFrame, results: DataFrame) -> DataFrame:
    """pass / warn / missing per budget with the percentage over it.

    ``budgets(benchmark, budget_ms, blocking)``, ``results(benchmark, mean_ms)``.
    """
    j = budgets.join(results, "benchmark", "left")
    pct = F.when(F.col("budget_ms") == 0, F.lit(0.0)).otherwise((F.col("mean_ms") - F.col("budget_ms")) / F.col("budget_ms") * 100.0)
    status = F.when(F.col("mean_ms").isNull(), "missing").when(F.col("mean_ms") <= F.col("budget_ms"), "pass").otherwise("warn")
    return j.select("benchmark", "blocking", status.alias("status"), F.round(pct, 4).alias("delta_pct"), (F.col("blocking") & (status != "pass")).alias("fails"))


def quality_rollup(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """Counts and the worst severity over a batch."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_RANK]), F.col("severity"))
    f = findings.agg(F.count(F.lit(1)).alias("findings"), F.count("recommendation").alias("recommendations"), F.coalesce(F.max(rank), F.lit(0)).alias("k"))
    n = assets.agg(F.count(F.lit(1)).alias("assets"))
    name = F.element_at(F.array(F.lit("none"), *[F.lit(s) for s in SEVERITY_RANK]), (F.col("k") + 1).cast("int"))
    # both inputs are one-row aggregates
    return n.join(f, F.lit(True)).select("assets", "findings", "recommendations", name.alias("highest_severity"))


def severity_cube(findings: DataFrame) -> DataFrame:
    return findings.rollup("asset_type", "severity").agg(F.count(F.lit(1)).alias("n"))


# Asset types with their mode and cleanup preset
# (type, mode, max colours, downscale, alpha, denoise, remove halos).
ASSET_TYPES = (
    ("sprite", "single", 24, "adaptive", "binary", 20, True), ("spriteSheet", "spriteSheet", 32, "dominant", "preserve", 20, True),
    ("animationSheet", "spriteSheet", 32, "dominant", "preserve", 20, True), ("characterSheet", "spriteSheet", 32, "dominant", "preserve", 20, True),
    ("tileset", "tileSheet", 16, "dominant", "preserve", 10, False), ("tilemap", "tileSheet", 32, "dominant", "preserve", 0, False),
    ("portrait", "single", 32, "adaptive", "preserve", 10, True), ("icon", "single", 16, "dominant", "binary", 15, True),
    ("iconSet", "spriteSheet", 16, "dominant", "binary", 15, True), ("uiElement", "single", 32, "adaptive", "preserve", 10, True),
    ("background", "single", 64, "adaptive", "preserve", 0, False),
)
# Accepted spellings of asset types.
TYPE_ALIASES = {
    "sprite": "sprite", "spritesheet": "spriteSheet", "sprite-sheet": "spriteSheet", "sheet": "spriteSheet", "animation": "animationSheet",
    "animationsheet": "animationSheet", "animation-sheet": "animationSheet", "character": "characterSheet", "charactersheet": "characterSheet",
    "character-sheet": "characterSheet", "tileset": "tileset", "tile": "tileset", "tilesheet": "tileset", "tile-sheet": "tileset", "tilemap": "tilemap",
    "portrait": "portrait", "icon": "icon", "iconset": "iconSet", "icon-set": "iconSet", "ui": "uiElement", "uielement": "uiElement", "background": "background",
}
# Quality profiles (id, max colours, downscale, alpha, denoise).
PROFILES = (
    ("balanced", 32, "adaptive", "preserve", 20), ("cleanSprite", 16, "adaptive", "binary", 20), ("cleanSheet", 16, "adaptive", "binary", 20),
    ("cleanIconSet", 16, "dominant", "binary", 15), ("tilesetSafe", 16, "dominant", "preserve", 0), ("preserveBackground", 64, "adaptive", "preserve", 0),
)


def asset_type_table(spark: SparkSession) -> DataFrame:
    """Alias -> type, mode and preset; two dozen fixed rows."""
    by = {t[0]: t for t in ASSET_TYPES}
    rows = [(alias, *by[t]) for alias, t in TYPE_ALIASES.items()]
    return spark.createDataFrame(rows, "alias string, asset_type string, mode string, base_colors bigint, base_downscale string, base_alpha string, base_denoise bigint, halos boolean")


def resolve_settings(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Settings per asset: override > quality profile > asset-type preset.

    ``rows(asset_id, type_name, profile, colors, downscale)``; unknown types give an error row.
    Both dimension tables are fixed in code, so they are broadcast.
    """
    prof = spark.createDataFrame(list(PROFILES), "profile string, p_colors bigint, p_downscale string, p_alpha string, p_denoise bigint")
    alias = F.lower(F.trim(F.replace(F.col("type_name"), F.lit("_"), F.lit(""))))
    j = rows.withColumn("alias", alias).join(F.broadcast(asset_type_table(spark)), "alias", "left").join(F.broadcast(prof), "profile", "left")
    return j.select("asset_id", "asset_type", "mode", F.coalesce("colors", "p_colors", "base_colors").alias("max_colors"), F.coalesce("downscale", "p_downscale", "base_downscale").alias("downscale"),
                    F.coalesce("p_alpha", "base_alpha").alias("alpha"), F.coalesce("p_denoise", "base_denoise").alias("denoise"), F.col("asset_type").isNull().alias("invalid_type"))


def normalise_hex(c: Column) -> Column:
    """Six lower-case digits; three-digit colours are doubled; anything else is null."""
    t = F.regexp_replace(F.trim(c), "^#", "")
    six = F.when(t.rlike("^[0-9a-fA-F]{3}$"), F.regexp_replace(t, "(.)", "$1$1")).otherwise(t)
    return F.when(six.rlike("^[0-9a-fA-F]{6}$"), F.concat(F.lit("#"), F.lower(six)))


def validate_palettes(palettes: DataFrame) -> DataFrame:
    """Issue rows of ``palettes(palette_id, name, colors ARRAY<STRING>)``; at most 512 colours each."""
    d = palettes.withColumn("hex", F.transform("colors", normalise_hex))
    bad = F.transform(F.filter(F.sequence(F.lit(0), F.size("hex") - 1), lambda i: F.get(F.col("hex"), i).isNull()),
                      lambda i: F.struct(F.lit("invalid-color").alias("code"), i.cast("string").alias("detail"), F.lit("error").alias("severity")))
    dup = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("hex") - 1, F.lit(1))), lambda i: F.get(F.col("hex"), i).isNotNull()
                               & (F.array_position("hex", F.get(F.col("hex"), i)) <= i)),
                      lambda i: F.struct(F.lit("duplicate-color").alias("code"), F.get(F.col("hex"), i).alias("detail"), F.lit("warning").alias("severity")))
    flag = lambda cond, code: F.array_compact(F.array(F.when(cond, F.struct(F.lit(code).alias("code"), F.lit("").alias("detail"), F.lit("error").alias("severity")))))
    empty = F.array().cast("array<struct<code:string,detail:string,severity:string>>")
    has = F.size("hex") > 0
    rows = F.concat(flag(F.length(F.trim("name")) == 0, "missing-name"), F.when(has, bad).otherwise(empty), F.when(has, dup).otherwise(empty), flag(~has, "empty-palette"))
    return d.select("palette_id", F.explode(rows).alias("i")).select("palette_id", "i.*")


# Failure categories and review states of fixture records.
FAILURE_CATEGORIES = (
    "bright-matte-halo", "noisy-pseudo-pixel-grid", "weak-ambiguous-grid", "uneven-row-sheet", "presentation-label-gutters", "palette-drift-animation",
    "outline-repair-failure", "morphology-artifact", "background-alpha-flood-fill", "sheet-detection-correction",
)
REVIEW_STATES = ("report-only", "golden-approved", "needs-review", "internal-only")


# Each rule: a code and the SQL condition that breaks it.
FIXTURE_RULES = (
    ("slug-format", "NOT slug RLIKE '^[a-z0-9]+(-[a-z0-9]+)*$'"),
    ("license-notes-empty", "trim(license_notes) = ''"),
    ("privacy-notes-empty", "trim(privacy_notes) = ''"),
    ("public-but-private-license", "privacy = 'safe-to-commit' AND license = 'private-do-not-commit'"),
    ("no-category", "size(categories) = 0"),
    ("no-source", "trim(source) = ''"),
    ("no-layout", "mode IN ('spriteSheet', 'tileSheet') AND NOT has_layout"),
    ("no-size", "mode = 'single' AND NOT has_size"),
)


def validate_fixtures(rows: DataFrame) -> DataFrame:
    """``fixture_id, code, value``: one row per broken rule of ``FIXTURE_RULES``, and per value outside its list.

    ``rows(fixture_id, slug, source, categories, review, mode, has_size, has_layout, privacy, privacy_notes, license, license_notes)``.
    """
    broken = F.map_filter(F.create_map(*[x for code, cond in FIXTURE_RULES for x in (F.lit(code), F.expr(cond))]), lambda k, v: v)
    rules = rows.select("fixture_id", F.explode(F.map_keys(broken)).alias("code"), F.lit(None).cast("string").alias("value"))
    listed = rows.select("fixture_id", F.explode("categories").alias("value")).where(~F.col("value").isin(*FAILURE_CATEGORIES)).select("fixture_id", F.lit("category-not-listed").alias("code"), "value")
    states = rows.where(~F.col("review").isin(*REVIEW_STATES)).select("fixture_id", F.lit("review-not-listed").alias("code"), F.col("review").alias("value"))
    return rules.unionByName(listed).unionByName(states)


# Next step per error code; the codes are fixed values, the steps are names of our own.
NEXT_STEPS = {
    "change-options": ("invalid_options",),
    "check-input": ("input_not_found", "unsupported_format", "decode_failed"),
    "check-output": ("output_exists", "unsafe_output", "encode_failed", "write_failed"),
    "set-grid-by-hand": ("processing_failed",),
    "export-one-target": ("export_failed",),
    "run-again": ("cancelled",),
}
NO_STEP, ANY_STEP = "none", "see-diagnostics"


def run_reports(runs: DataFrame, spark: SparkSession) -> DataFrame:
    """Report row per run: status, exit code, whole redacted message and the next step.

    ``runs(run_id, status, code, exit_code, message)``; the table of steps is fixed in code.
    """
    steps = spark.createDataFrame([(c, step) for step, codes in NEXT_STEPS.items() for c in codes], "code string, step string")
    j = runs.join(F.broadcast(steps), "code", "left")
    step = F.when(F.col("status") == "success", NO_STEP).otherwise(F.coalesce("step", F.lit(ANY_STEP)))
    return j.select("run_id", F.lit(1).cast("long").alias("schema_version"), "status", "exit_code", text.redact(F.col("message")).alias("message"), step.alias("next_step"))


def edit_palettes(palettes: DataFrame, edits: DataFrame) -> DataFrame:
    """One edit per palette: add, update, remove or reorder a colour; positions are re-ranked.

    ``palettes(palette_id, pos, color)``, ``edits(palette_id, op, at, to, color)``.
    """
    e = edits.select("palette_id", "op", "at", "to", F.col("color").alias("new"))
    j = palettes.join(e, "palette_id", "left")
    op, at, to, pos = F.col("op"), F.col("at"), F.col("to"), F.col("pos")
    moved = F.when(pos == at, to).when((at < to) & pos.between(at + 1, to), pos - 1).when((at > to) & pos.between(to, at - 1), pos + 1).otherwise(pos)
    kept = j.filter(~((op == "remove") & (pos == at)) | op.isNull()).select(
        "palette_id", F.when((op == "add") & (pos >= at), pos + 1).when((op == "remove") & (pos > at), pos - 1).when(op == "reorder", moved).otherwise(pos).alias("pos"),
        F.when((op == "update") & (pos == at), F.col("new")).otherwise(F.col("color")).alias("color"))
    added = e.filter(op == "add").select("palette_id", at.alias("pos"), F.col("new").alias("color"))
    return kept.unionByName(added)
