"""Bounded training samples: which rows may be learned from, and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.rows import text_rows

#: Rows with longer texts are not learned from (they are scored whole); so rows bound the bytes of a sample.
LEARN_CHARS = 50_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id, y``: one row per id; ids without a label or with labels that disagree are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_hi")).where("y = _hi").select("doc_id", "y")


def pick(rows: DataFrame, n: int, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` of about ``n`` distinct ids: those with the smallest hash of their ``doc_id``.

    A hash bound thins the rows out first, so the ordered take never gathers much more than
    ``limit``; copies of an id share its hash and become one row before they are ordered.
    """
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40))
    bound = (1 << 40) if n <= limit else int((1 << 40) * min(1.0, 1.2 * limit / n))
    return rows.select("doc_id", order.alias("_order")).where(F.col("_order") < bound).distinct().orderBy("_order", "doc_id").limit(limit).drop("_order")


def distinct_ids(rows: DataFrame) -> int:
    """About how many distinct ids ``rows`` has; copies of a row don't count."""
    return rows.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]


def texts_of(docs: DataFrame, picked: DataFrame, by: str = "kind") -> DataFrame:
    """One text for each picked ``doc_id`` and ``by``: of rows that repeat an id, the text with the smallest hash.

    ``picked`` has a bounded number of rows, so it is sent to every task, and so is the result.
    """
    held = text_rows(docs).where(F.length(F.coalesce("text", F.lit(""))) <= LEARN_CHARS).withColumn("text", F.coalesce("text", F.lit("")))
    return held.join(F.broadcast(picked), "doc_id").groupBy("doc_id", by).agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))


def gather(docs: DataFrame, picked: DataFrame, limits: dict[str, int]) -> dict[str, list[str]]:
    """Texts of the picked ids by ``kind``, in order of their ids, never more than the kind's limit."""
    sample = sorted(texts_of(docs, picked).collect(), key=lambda r: (r["kind"], r["doc_id"]))
    by = {k: [r["text"] for r in sample if r["kind"] == k] for k in limits}
    over = {k: len(t) for k, t in by.items() if len(t) > limits[k]}
    if over:
        raise AssertionError(f"more learning rows than their limit: {over}")
    return by
