"""Gridloom: raster analytics over collections of small images, as Spark DataFrames.

Every public operator is a plain function ``DataFrame -> DataFrame``.  One row is one
pixel, colour, tile, frame, palette entry, manifest or event; ``asset_id`` is always the
first grouping key, so a single job covers a whole collection.
"""

__version__ = "0.1.0"
