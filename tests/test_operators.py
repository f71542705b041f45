"""Small hand-made cases, skew helpers, sinks and invariants."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gridloom.operators import alpha, diagnostics, frames, histogram, ordering, palette
from gridloom.sources import palette_files, rasters

RED, BLUE, CLEAR = (200, 10, 20, 255), (10, 20, 200, 255), (0, 0, 0, 0)


def test_rank_in_chunks_equals_row_number(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 13).alias("c"), F.col("id"))
    got = ordering.rank_in_chunks(df, ["k"], ["c"], ["id"], "r")
    from pyspark.sql import Window as W

    want = df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("c", "id")).cast("long"))
    assert sorted(map(tuple, got.select("k", "c", "id", "r").collect())) == sorted(map(tuple, want.select("k", "c", "id", "r").collect()))


def test_running_sum_crosses_chunks(spark):
    df = spark.range(50).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    got = ordering.running_sum(df, ["k"], "o", F.col("o"), "s", chunk_rows=7).orderBy("o").collect()
    assert [r.s for r in got] == [i * (i + 1) // 2 for i in range(50)]


def test_remap_is_idempotent_and_stays_in_palette(spark, raster):
    px = raster({1: [[RED, (205, 12, 22, 255), BLUE], [CLEAR, BLUE, RED]]})
    pal = histogram.frequency_palette(histogram.histogram(px), 2)
    once = palette.remap(px, pal).select(*px.columns)
    twice = palette.remap(once, pal).select(*px.columns)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    seen = {(r.r, r.g, r.b) for r in once.filter("a > 0").collect()}
    assert len(seen) <= 2


def test_binary_alpha_is_idempotent(spark, raster):
    px = raster({1: [[(1, 2, 3, v) for v in (0, 127, 128, 255)]]})
    once = alpha.binary_alpha(px)
    assert [r.a for r in once.orderBy("idx").collect()] == [0, 0, 255, 255]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, alpha.binary_alpha(once).collect()))


def test_empty_asset_gets_black_palette(spark, raster):
    px = raster({1: [[RED]], 2: [[CLEAR]]})
    pal = histogram.frequency_palette(histogram.histogram(px), 4, px.select("asset_id").distinct())
    assert {(r.asset_id, r.color) for r in pal.collect()} == {(1, 200 << 16 | 10 << 8 | 20), (2, 0)}


def test_scene_stride_sample(spark, raster):
    px = raster({1: [[RED, BLUE] * 10 for _ in range(20)]})
    assert diagnostics.scene(px).first().samples == 400
    assert diagnostics.scene(px, max_samples=100).first().samples == 100


def test_raster_strips_concatenate(spark, raster):
    px = raster({1: [[(x, y, 7, 255) for x in range(5)] for y in range(9)]})
    strips = rasters.assemble_rasters(px, strip_pixels=10).orderBy("strip").collect()
    assert len(strips) == 5
    raw = b"".join(bytes(s.content) for s in strips)
    assert raw == bytes(v for y in range(9) for x in range(5) for v in (x, y, 7, 255))
    whole = spark.createDataFrame([(1, 5, 9, bytearray(raw)), (2, 5, 9, bytearray(raw[:-1]))], "asset_id long, width int, height int, content binary")
    good, bad = rasters.explode_rasters(whole)
    assert sorted(map(tuple, good.select(*px.columns).collect())) == sorted(map(tuple, px.collect()))
    assert bad.collect()[0].asset_id == 2


def test_sink_refuses_to_overwrite(spark, raster, tmp_path):
    px = raster({1: [[RED]], 2: [[BLUE]]})
    path = str(tmp_path / "out")
    rasters.write_results(px, path, buckets=2)
    with pytest.raises(AnalysisException):
        rasters.write_results(px, path, buckets=2)
    rasters.write_results(px, path, overwrite=True, buckets=2)
    assert spark.read.parquet(path).count() == 2


def test_palette_files_round_trip(spark, tmp_path):
    pal = spark.createDataFrame([("a", 0, "#010203"), ("a", 1, "#ff8000"), ("b", 0, "#ffffff")], "palette_id string, pos long, color string")
    texts = palette_files.write_texts(pal)
    want = sorted(map(tuple, pal.collect()))
    for col, parse in (("hex_text", palette_files.parse_hex), ("gimp_text", palette_files.parse_gimp), ("jasc_text", palette_files.parse_jasc)):
        back = parse(texts.select("palette_id", F.col(col).alias("text")))
        assert sorted(map(tuple, back.select("palette_id", "pos", "color").collect())) == want
    (tmp_path / "x.hex").write_text("#010203\n; note\nFF8000 orange\n")
    got = palette_files.parse_hex(palette_files.read_palette_texts(spark, str(tmp_path)))
    assert [r.color for r in got.orderBy("pos").collect()] == ["#010203", "#ff8000"]


def test_frames_at_spans_buckets(spark, raster):
    px = raster({1: [[RED] * 6 for _ in range(4)]})
    f = spark.createDataFrame([(1, 0, 1, 1, 4, 2), (1, 1, 3, 0, 3, 4)], "asset_id long, frame_idx long, x long, y long, w long, h long")
    got = {(r.frame_idx, r.x, r.y) for r in frames.frames_at(px, f, bucket=2).collect()}
    want = {(0, x, y) for x in range(1, 5) for y in range(1, 3)} | {(1, x, y) for x in range(3, 6) for y in range(4)}
    assert got == want


def test_job_stream_ignores_arrival_order(spark, tmp_path):
    """Late progress, a late earlier end and a split over files give the state of the batch form."""
    import datetime as dt

    from gridloom.streaming import jobs

    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, 1, at(1), "queued", 0.0), (1, 2, at(2), "running", 0.2), (1, 3, at(3), "running", 0.6), (1, 4, at(4), "failed", 0.6), (1, 5, at(6), "completed", 1.0),
            (2, 6, at(1), "queued", 0.0), (2, 7, at(2), "running", 0.3), (2, 8, at(5), "running", 0.9), (3, 9, at(9), "cancelled", 0.0), (3, 10, at(3), "running", 0.5)]
    schema = "job_id long, event_id long, ts timestamp, status string, progress double"
    for n, part in enumerate(([rows[4], rows[2], rows[7], rows[8]], [rows[0], rows[9], rows[5]], [rows[3], rows[1], rows[6]])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del n
    stream = jobs.latest_jobs_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    seen = {}
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, i: seen.update({r.job_id: tuple(r) for r in df.collect()})).start()
    q.processAllAvailable()
    q.stop()
    want = jobs.latest_jobs(spark.createDataFrame(rows, schema)).drop("events").collect()
    assert sorted(seen.values()) == sorted(map(tuple, want))
