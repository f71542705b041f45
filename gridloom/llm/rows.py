"""Shared pieces: written tables in the shared folder, row identity, Arrow mapping, salts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import shared_folder

CHUNK_CHARS = 1 << 18
# Of a batch of rows, so many bytes of text become Python strings at a time.
SLICE_BYTES = 1 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; any executor can read what another wrote there."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The lineage ends at the files, so a lost executor costs a re-read and no recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unless_large(ids: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """Mark a written table of one or two id columns for broadcast if it has at most ``limit`` rows (32 MB); a larger one is shuffled."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only: other columns, whatever their names, never reach the work."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_key() -> list[Column]:
    """Join key of a row: null ids and texts get fixed values, equal rows get equal keys."""
    return [F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit("\0null"))).alias("_tx")]


def bundles(texts: Iterable[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows with about ``limit`` characters each, so numpy arrays stay small; null counts as empty.

    Yields the index of the first row and the texts.
    """
    start, size, held = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > limit:
            yield start, held
            start, size, held = i, 0, []
        held.append(t)
        size += len(t)
    if held:
        yield start, held


def map_texts(df: DataFrame, fn: Callable[[list, list], dict], schema: str, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """``fn(ids, texts) -> {column: values}`` over bounded runs of rows, as one map without a shuffle."""
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in text_slices(whole, 1, SLICE_BYTES)):
            keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, part in bundles(values):
                got = fn(keys[at : at + len(part)], values[at : at + len(part)])
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(ids, text).mapInArrow(run, out)


def text_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text each; a longer text is a run of its own, null has none."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
