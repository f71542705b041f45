"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridloom import catalog  # noqa: E402
from gridloom.session import build_session  # noqa: E402

HEADLINE = [
    "j01_nearest_palette_usage", "j01_remap_pixels", "a01_exact_histogram", "a03_frequency_palette", "a10_downsample_dominant", "a11_downsample_median",
    "w02_edge_profile", "x01_grid_candidates", "a09_sprite_bounds", "h07_tilemap_summary", "a25_seam_summary", "a32_stability_summary",
    "s08_atlas_json", "a34_validation_summary", "m02_job_state",
]
#: The composed fix runs on the next smaller collection, outside the total: its stages wait for each other's checkpoints.
CLEANUP = "x17_fix_single"
PIXELS_PER_PART = 24 * 24


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load()
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    cleanup = None
    if os.path.isdir(small):
        start = time.perf_counter()
        catalog.QUERIES[CLEANUP](spark, small).write.format("noop").mode("overwrite").save()
        cleanup = round(time.perf_counter() - start, 3)
    pixels = parts * PIXELS_PER_PART
    rate = {n: round(pixels / times[n] / 1e6, 2) for n in ("j01_remap_pixels", "a10_downsample_dominant", "x01_grid_candidates", "a01_exact_histogram")}
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "mpixels_per_sec": rate, "full_cleanup_sf0.01": cleanup}))
    spark.stop()


if __name__ == "__main__":
    main()
