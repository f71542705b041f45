"""The layout confidence model of a sheet: five scores, not three."""
from gridloom import catalog
from gridloom.operators import sheets as S

catalog.load()
ROW = "asset_id long, row long, start long, end long, img_w long, img_h long, merged_count long, drift long, s array<struct<x: long, w: long>>"


def test_uneven_gutters_and_all_labels(spark):
    wide = [(2, 18), (22, 18), (42, 18)]
    rows = [(1, 0, 4, 23, 64, 64, 0, 0, [(7, 6), (26, 8), (47, 6)]), (1, 1, 30, 49, 64, 64, 0, 0, wide), (2, 0, 4, 23, 64, 64, 0, 0, wide), (2, 1, 30, 45, 64, 64, 2, 2, wide), (3, 0, 4, 23, 64, 64, 0, 0, [(9, 20)])]
    centred = S.centre_content(spark.createDataFrame(rows, ROW))
    cells = {(r.asset_id, r.row): (r.centered, [tuple(q) for q in r.s]) for r in centred.collect()}
    assert cells[1, 0] == (True, [(0, 20), (20, 20), (40, 20)])
    assert [k for k, v in cells.items() if v[0]] == [(1, 0)] and cells[2, 1][1] == wide
    got = {r.asset_id: r for r in S.layout_confidence(centred).collect()}
    scores = lambda r: tuple((r[k], r[f"{k}_label"]) for k in ("row_band", "column_pitch", "row_name", "gutter_normalization", "component_merge"))
    assert scores(got[1]) == ((0.68, "medium"), (0.92, "high"), (0.24, "low"), (0.64, "medium"), (0.92, "high"))
    # heights 20 and 16: 0.68 - 4 / 18 * 0.55; drift 2 of pitch 20; two merged of six
    assert scores(got[2]) == ((0.56, "medium"), (0.63, "medium"), (0.24, "low"), (0.9, "high"), (0.59, "medium"))
    assert scores(got[3]) == ((0.34, "low"), (0.28, "low"), (0.24, "low"), (0.9, "high"), (0.92, "high"))
    assert [got[i].warnings for i in (1, 2, 3)] == ["generated-row-names,gutters-normalized", "drift-fitted,generated-row-names,merged-parts", "one-row-band,too-few-columns,generated-row-names"]


def test_every_sheet_has_all_parts(spark):
    rows = catalog.QUERIES["h06_layout_confidence"](spark, "/root/testdata/sf0.001").collect()
    sheets = catalog.QUERIES["h01_sheet_layout"](spark, "/root/testdata/sf0.001").collect()
    assert {r.asset_id for r in rows} == {r.asset_id for r in sheets}
    assert all(r[k] is not None for r in rows for k in r.asDict())
