"""Text helpers: buckets, redaction, error classes and path guards, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
MEMORY_BUDGET = 128 * 1024 * 1024

# Secret patterns and their replacements, applied in this order.
REDACTIONS = (
    (r"(?i)\b(Bearer)\s+([A-Za-z0-9._~+/=-]{8,})\b", "$1 [REDACTED]"),
    (r"(?i)\b([A-Z0-9_]*(?:API[-_]?KEY|TOKEN|SECRET|PASSWORD|AUTHORIZATION)[A-Z0-9_]*)\s*=\s*([^\s,;]+)", "$1=[REDACTED]"),
    (r"\b(?:sk|pk|rk)-[A-Za-z0-9_-]{8,}\b", REDACTED),
    (r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b", REDACTED),
    (r"(?i)\b(prompt)\s+[^.\n\r]+", "$1 [REDACTED]"),
)
SECRET_KEY = r"(?i)(?:api[-_]?key|token|secret|password|passwd|authorization|auth|credential|private[-_]?prompt|negative[-_]?prompt|prompt)"

# Byte-size bucket bounds.
SIZE_BUCKETS = ((100 * 1024, "0-100kb"), (1024**2, "100kb-1mb"), (5 * 1024**2, "1mb-5mb"), (20 * 1024**2, "5mb-20mb"))


def size_bucket(n: Column) -> Column:
    out = F.when(n.isNull() | (n < 0), "unknown")
    for bound, name in SIZE_BUCKETS:
        out = out.when(n < bound, name)
    return out.otherwise("20mb-plus")


def normalise(s: Column) -> Column:
    t = F.lower(F.trim(s))
    return F.when(F.length(t) == 0, "unknown").otherwise(t)


def ratio(v: Column) -> Column:
    """Clamp to 0..1 at four decimals; null and NaN give null."""
    return F.when(v.isNull() | F.isnan(v), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(v, 4))))


def error_kind(message: Column, operation: Column) -> Column:
    m = F.lower(message)
    has = lambda *words: m.rlike("|".join(words))
    return (
        F.when(has("cancel"), "cancelled").when(has("permission", "denied", "not allowed"), "permission_denied")
        .when(has("worker", "postmessage", "stale"), "worker_failed").when(operation == "render", "render_failed")
        .when(operation == "export", "export_failed")
        .when((operation == "import") & has("decode", "image", "png", "jpeg", "webp"), "decode_failed").otherwise("unknown"))


def redact(s: Column, max_length: int | None = None) -> Column:
    """Replace secrets in the whole text; ``max_length`` adds the report cut-off."""
    for pattern, to in REDACTIONS:
        s = F.regexp_replace(s, pattern, to)
    if max_length is None:
        return s
    return F.when(F.length(s) > max_length, F.concat(F.substring(s, 1, max_length), F.lit("...[truncated]"))).otherwise(s)


def redact_map(m: Column) -> Column:
    return F.transform_values(m, lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit(REDACTED)).otherwise(redact(v)))


def safe_bundle_path(p: Column) -> Column:
    n = F.replace(p, F.lit("\\"), F.lit("/"))
    bad = (F.length(n) == 0) | n.startswith("/") | n.rlike("(?i)^[a-z]:") | F.exists(
        F.split(n, "/"), lambda part: (part == "..") | (F.length(part) == 0))
    return ~bad


def safe_frame_file(name: Column, index: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(F.length(s) > 0, s).otherwise(F.format_string("frame_%03d", index))
