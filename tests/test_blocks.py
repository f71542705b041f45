"""Blocks of one or two colours take a short way; the result is that of the full rounds."""

import statistics

from gridloom.operators import downsample, quantise

A, B, C, D = (10, 20, 200, 255), (11, 20, 200, 255), (240, 90, 3, 255), (90, 200, 40, 128)
CLEAR = (7, 8, 9, 0)
BLOCKS = [[A] * 4, [A, B, B, B], [A, B, A, B], [B, A, A, B], [CLEAR] * 4, [CLEAR, C, A, CLEAR], [A, C, D, C], [CLEAR, CLEAR, CLEAR, D], [C, C, (*C[:3], 90), A]]


def cells(spark, raster):
    img = [sum(([b[2 * y], b[2 * y + 1]] for b in BLOCKS), []) for y in range(2)]
    from pyspark.sql import functions as F

    return downsample.cell_colors(downsample.to_cells(raster({1: img}), F.lit(2).cast("long")))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_median_of_blocks(spark, raster):
    out = downsample.median(cells(spark, raster))
    assert "percentile" not in plan(out)
    got = {r.cx: (r.r, r.g, r.b, r.a) for r in out.collect()}
    for i, b in enumerate(BLOCKS):
        vis = [p for p in b if p[3] >= 16] or b
        want = [int(statistics.median(p[k] for p in vis) + 0.5) for k in range(3)] + [int(statistics.median(p[3] for p in b) + 0.5)]
        assert got[i] == tuple(want), (i, got[i], want)


def test_two_colour_blocks_need_no_rounds(spark, raster):
    for space in (False, True):
        out = quantise.block_clusters(cells(spark, raster), space)
        assert "few" in plan(out)
        got = {r.cx: (r.r, r.g, r.b) for r in out.collect()}
        for i, b in enumerate(BLOCKS):
            vis = [p[:3] for p in b if p[3] >= 16]
            if len(set(vis)) in (1, 2):
                assert got[i] == max(dict.fromkeys(vis), key=vis.count), (space, i)
        assert got[4] == (CLEAR[:3] if space else (0, 0, 0))
        assert got[6] == C[:3]
