"""Catalog modules, in load order."""

NAMES = ["color_queries", "palette_queries", "alpha_queries", "downsample_queries", "grid_queries", "tile_queries", "raster_queries", "source_queries", "frame_queries", "job_queries", "iterative_queries", "sheet_queries", "rule_queries", "fix_queries", "detection_queries"]
