"""Job lifecycle, latest-only requests, progress and result reuse.

Batch forms work on a finished event table; ``*_stream`` forms give the same table from a
Structured Streaming source.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled")
STATUSES = ("queued", "running", "completed", "failed", "cancelled")


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def first_terminal(events: DataFrame) -> DataFrame:
    """Earliest terminal event per job."""
    t = events.filter(F.col("status").isin(*TERMINAL))
    return t.groupBy("job_id").agg(F.min(F.struct("ts", "event_id", "status")).alias("end"))


def until_terminal(events: DataFrame) -> DataFrame:
    j = events.join(first_terminal(events), "job_id", "left")
    return j.filter(F.col("end").isNull() | (F.struct("ts", "event_id") <= F.struct("end.ts", "end.event_id")))


def latest_jobs(events: DataFrame) -> DataFrame:
    """One row per job.  The first terminal state sticks; a completed job has progress 1.

    Only mergeable aggregates meet per job, so a busy job is reduced before the shuffle.
    """
    g = until_terminal(events).groupBy("job_id").agg(
        F.max(F.struct("ts", "event_id", "status")).alias("last"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started"),
        F.max(F.when(~F.col("status").isin(*TERMINAL), F.struct("ts", "event_id", "progress"))).alias("live"), F.count(F.lit(1)).alias("events"))
    status = F.col("last.status")
    return g.select(
        "job_id", status.alias("status"), F.when(status == "completed", F.lit(1.0)).otherwise(F.round(_clamp(F.coalesce("live.progress", F.lit(0.0))), 6)).alias("progress"),
        F.unix_micros("started").alias("started_us"), F.when(status.isin(*TERMINAL), F.unix_micros("last.ts")).alias("completed_us"), "events")


def status_counts(jobs: DataFrame) -> DataFrame:
    """Totals by status in one row."""
    return jobs.groupBy().pivot("status", list(STATUSES)).agg(F.count(F.lit(1))).na.fill(0).withColumn(
        "total", sum((F.col(s) for s in STATUSES[1:]), F.col(STATUSES[0])))


def latest_only(requests: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Newest request per stale key is kept; older ones are marked stale.

    The newest id per key is a mergeable aggregate; no key is sorted in one task.
    """
    top = requests.groupBy(*keys).agg(F.max(F.struct("ts", "event_id")).alias("newest"))
    j = requests.join(top, list(keys))
    return j.withColumn("kept", F.col("event_id") == F.col("newest.event_id")).drop("newest")


def percent(progress: Column) -> Column:
    """Whole percent 0..100; only a finished job shows 100."""
    raw = F.least(F.lit(100.0), F.greatest(F.lit(0.0), progress * 100.0))
    r = F.floor(raw + 0.5)
    return F.when((raw < 100) & (r == 100), 99).otherwise(r).cast("long")


def progress_stream(events: DataFrame) -> DataFrame:
    """Never-falling percent per job, nothing after its first terminal event."""
    from gridloom.operators.ordering import running_max

    live = until_terminal(events).drop("end")
    done = F.when(F.col("status") == "completed", F.lit(100).cast("long")).otherwise(percent(F.col("progress")))
    return running_max(live, ["job_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"), done, "percent").select("job_id", "event_id", "status", "percent")


_STATE = "end_us bigint, end_id bigint, end_status string, marks array<struct<us: bigint, event_id: bigint, status: string, progress: double>>"
_FIELDS = ("end_us", "end_id", "end_status", "marks")
_OUT = "job_id bigint, status string, progress double, started_us bigint, completed_us bigint"


def _fold(key, batches: Iterator, state) -> Iterator:
    """Merge one job's events into its state.

    Every field keeps the (time, event id) it comes from and changes only for an event that beats it, so
    the state is the same in whatever order and batches events arrive. The earliest terminal event ends a
    job; what happened after it does not count.
    """
    import pandas as pd

    seen = {n: None for n in _FIELDS} if not state.exists else dict(zip(_FIELDS, state.get))
    marks = [] if seen["marks"] is None else [tuple(m) for m in seen["marks"]]
    for pdf in batches:
        for us, event_id, status, value in zip(pdf["us"], pdf["event_id"], pdf["status"], pdf["progress"]):
            at = (int(us), int(event_id))
            if status in TERMINAL:
                if seen["end_us"] is None or at < (seen["end_us"], seen["end_id"]):
                    seen |= {"end_us": at[0], "end_id": at[1], "end_status": status}
            else:
                marks.append((*at, status, float(value)))
    end = None if seen["end_us"] is None else (seen["end_us"], seen["end_id"])
    # Before the end: the first running event and the latest event are all that is ever asked for, but an
    # earlier end may still arrive, so older events stay until then.
    marks = sorted(set(m for m in marks if end is None or m[:2] < end))
    seen["marks"] = marks
    state.update(tuple(seen[n] for n in _FIELDS))
    started = next((m[0] for m in marks if m[2] == "running"), None)
    status = seen["end_status"] or (marks[-1][2] if marks else None)
    shown = 1.0 if seen["end_status"] == "completed" else round(max(0.0, min(1.0, marks[-1][3] if marks else 0.0)), 6)
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [shown],
                        "started_us": pd.array([started], dtype="Int64"), "completed_us": pd.array([seen["end_us"]], dtype="Int64")})


def latest_jobs_stream(events: DataFrame) -> DataFrame:
    """Streaming form of ``latest_jobs``: keyed state, one updated row per job and batch.

    A micro-batch bounds how much of one job is in memory; limit it with
    ``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger`` at the source.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    e = events.select("job_id", F.unix_micros("ts").alias("us"), "event_id", "status", "progress")
    return e.groupBy("job_id").applyInPandasWithState(_fold, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def latest_only_stream(requests: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Newest request per key as a streaming aggregate (complete or update mode)."""
    return requests.groupBy(*keys).agg(F.max(F.struct("ts", "event_id")).alias("newest"), F.count(F.lit(1)).alias("requests")).select(
        *keys, F.col("newest.event_id").alias("event_id"), "requests")


def cache_key(*cols: Column) -> Column:
    return F.concat_ws("|", *cols)


def reuse_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Exact hit by key, else any result of the asset (least key), else a miss.

    ``requests(asset_id, key)``, ``results(asset_id, key, report)``.
    """
    exact = results.groupBy("asset_id", "key").agg(F.min("report").alias("exact"))
    spare = results.groupBy("asset_id").agg(F.min_by("report", "key").alias("fallback"))
    j = requests.join(exact, ["asset_id", "key"], "left").join(spare, "asset_id", "left")
    kind = F.when(F.col("exact").isNotNull(), "exact").when(F.col("fallback").isNotNull(), "fallback").otherwise("miss")
    return j.select("asset_id", "key", kind.alias("hit"), F.coalesce("exact", "fallback").alias("report"))


def work_to_do(requests: DataFrame, results: DataFrame) -> DataFrame:
    return requests.join(results, ["asset_id", "key"], "left_anti")


def prune_results(results: DataFrame, assets: DataFrame) -> DataFrame:
    return results.join(assets, "asset_id", "left_semi")


REASONS = ("settings", "output", "frames", "metadata", "export")


def changed_assets(current: DataFrame, clean: DataFrame) -> DataFrame:
    """Which parts differ from the saved snapshot; an asset without a snapshot is clean."""
    c = clean.select("asset_id", F.lit(True).alias("saved"), *[F.col(r).alias(f"old_{r}") for r in REASONS])
    j = current.join(c, "asset_id", "full_outer").filter(F.col("settings").isNotNull())
    diff = F.array_compact(F.array(*[F.when(F.coalesce("saved", F.lit(False)) & ~F.col(r).eqNullSafe(F.col(f"old_{r}")), F.lit(r)) for r in REASONS]))
    return j.select("asset_id", (F.size(diff) > 0).alias("dirty"), F.array_join(diff, ",").alias("reasons"))


def first_marks(marks: DataFrame, keys: tuple[str, ...], phase: str) -> DataFrame:
    """First mark of each phase and its time since the first mark of the key, in microseconds."""
    first = marks.groupBy(*keys, phase).agg(F.min("ts").alias("ts"))
    start = marks.groupBy(*keys).agg(F.min("ts").alias("t0"))
    return first.join(start, list(keys)).select(*keys, phase, (F.unix_micros("ts") - F.unix_micros("t0")).alias("elapsed_us"))


def phase_summary(marks: DataFrame, keys: tuple[str, ...], ms: str, threshold: Column) -> DataFrame:
    """Count, range, mean and approximate median per phase, with a slow-phase count."""
    return marks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.round(F.avg(ms), 6).alias("avg_ms"),
        F.percentile_approx(ms, 0.5, 10000).alias("median_ms"), F.count_if(F.col(ms) >= threshold).alias("slow"))
