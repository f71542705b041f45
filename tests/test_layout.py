"""Plans over pixel collections: no pixels through the driver, no shuffle where pixels are in place."""
import re

import pytest

from gridloom import catalog

SF = "/root/testdata/sf0.001"
catalog.load()


def plan(df, capsys):
    capsys.readouterr()
    df.explain("simple")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", ["w04_row_bands", "h10_seam_repair", "x06_halo_removal", "x04_regularise_mixels", "j10_source_lookup", "l02_palette_order", "u03_active_vs_frame_colors"])
def test_no_hash_join_through_the_driver(spark, capsys, name):
    """Spark took the pixels of a few kilobytes of seeds for a small table."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
    try:
        text = plan(catalog.QUERIES[name](spark, SF), capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" not in text


@pytest.mark.parametrize("name", ["w02_edge_profile", "j02_neighbour_stencil", "x06_halo_removal"])
def test_pixels_stay_in_place(spark, capsys, name):
    """The one exchange deals seed rows, which have no place in the image yet."""
    for line in plan(catalog.QUERIES[name](spark, SF), capsys).split("\n"):
        if "Exchange hashpartitioning" in line:
            assert re.search(r"hashpartitioning\(asset_id#\d+L, \d+\), REPARTITION_BY_NUM", line), line


def test_gradients_are_worked_out_once_for_tiles(spark, capsys):
    assert plan(catalog.QUERIES["x02_sobel_tiles"](spark, SF), capsys).count("Range (0, 96,") == 1


def test_clips_stay_off_the_driver(spark, capsys):
    """The files of orders are small, their unfolded clips are not."""
    assert "Broadcast" not in plan(catalog.QUERIES["s11_frame_tags"](spark, SF), capsys)


SHEETS = [("sheets", n) for n in ("h01_sheet_layout", "h06_layout_confidence", "h06_row_confidence", "h01_layout_frames")]
ROUNDS = [("peeling", "i04_matte_rings"), ("components", "i02_border_flood_fill"), ("leaders", "x07_denoise"), ("tiles", "h10_seam_repair"), ("tiles", "u03_active_vs_frame_colors")]


@pytest.mark.parametrize("module,name", SHEETS + ROUNDS)
def test_no_table_that_grows_goes_through_the_driver(spark, monkeypatch, module, name):
    """Tables whose size is known at run time only were broadcast: lines of sheets, rings, runs, leaders, seams."""
    from importlib import import_module

    from gridloom import session

    plans = []

    def cut(df):
        done = session.cut_lineage(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return done

    monkeypatch.setattr(import_module(f"gridloom.operators.{module}"), "cut_lineage", cut, raising=False)
    df = catalog.QUERIES[name](spark, SF)
    df.collect()
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_adaptive_cells_meet_without_a_join(spark, capsys):
    """Dominant and median colours of a cell came from two passes whose cells were shuffled to meet."""
    text = plan(catalog.QUERIES["a12_downsample_adaptive"](spark, SF), capsys)
    assert "SortMergeJoin" not in text and "HashJoin" not in text
    for line in text.split("\n"):
        if "Exchange hashpartitioning" in line:
            assert re.search(r"hashpartitioning\(asset_id#\d+L, \d+\), REPARTITION_BY_NUM", line), line


def test_renames_are_dealt_by_rows(spark, monkeypatch):
    """A join of frames had the usual number of partitions, so a task's rows grew with the orders."""
    from gridloom.operators import frame_edits

    monkeypatch.setattr(frame_edits, "PART_ROWS", 256, raising=False)
    out = catalog.QUERIES["h14_rename_override_keys"](spark, SF)
    rows = out.count()
    assert rows > 256 * 8 and out.rdd.getNumPartitions() >= rows // 256
