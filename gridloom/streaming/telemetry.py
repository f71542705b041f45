"""Consent-gated usage events: stateless column work, the same for batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import text

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """File stream over ``events.parquet`` files below ``folder``."""
    s = spark.readStream.schema(spark.read.parquet(f"{folder}/events.parquet").schema)
    return s.option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events.parquet").parquet(folder)


def scalar_props(props: Column) -> Column:
    """Flat properties of a JSON object; nested values are dropped."""
    m = F.from_json(props, T.MapType(T.StringType(), T.StringType()))
    return F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: v.isNull() | ~v.rlike(r"^\s*[\[{]"))


def ingest(events: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Keep events with consent and whitelisted scalar properties; add buckets.

    ``events(event_id, session_id, ts, event, value, props, consent)``.
    """
    kept = F.map_filter(scalar_props(F.col("props")), lambda k, v: k.isin(*allowed))
    return events.filter("consent").select(
        "event_id", "session_id", "ts", text.normalise(F.col("event")).alias("event"), kept.alias("props"),
        F.greatest(F.lit(0).cast("long"), F.floor(F.col("value") + 0.5).cast("long")).alias("duration_ms"),
        text.size_bucket(F.col("value") * 40000).alias("size_bucket"))


def ingest_stream(events: DataFrame, allowed: tuple[str, ...], watermark: str | None = None) -> DataFrame:
    """As ``ingest``, with repeats of an event id dropped.

    No event is lost for being late: the state holds every id seen. With a ``watermark`` the state is bounded,
    and what arrives later than that is dropped.
    """
    if watermark is None:
        return ingest(events.dropDuplicates(["event_id"]), allowed)
    return ingest(events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"]), allowed)
