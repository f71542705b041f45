import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", 4, **{"spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def raster(spark):
    """Build pixel rows from nested lists of (r, g, b, a) per asset."""
    def make(images):
        rows = []
        for asset, img in images.items():
            h, w = len(img), len(img[0])
            rows += [(asset, y * w + x, x, y, w, h, *img[y][x]) for y in range(h) for x in range(w)]
        return spark.createDataFrame(rows, "asset_id long, idx long, x long, y long, w long, h long, r long, g long, b long, a long")

    return make
