"""Peeling, drift, Sobel votes, background models and subject passes against brute force and hand-made rasters."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import background, drift, foreground, grey_shell, outline_candidates, peeling, sobel, subject

CLEAR, RED, GREY = (0, 0, 0, 0), (200, 30, 40, 255), (232, 236, 240, 255)


def blocks(w, h, scale, phase, seed):
    rng = random.Random(seed)
    colors = {}
    return [[colors.setdefault(((x - phase) // scale, (y - phase) // scale), tuple(rng.randrange(0, 256, 5) for _ in range(3)) + (255,)) for x in range(w)] for y in range(h)]


def peel_brute(img, limit):
    h, w = len(img), len(img[0])
    ring = {(x, y): 0 for y in range(h) for x in range(w) if img[y][x][3] == 0}
    last = list(ring)
    for r in range(1, limit + 1):
        found = {(x + dx, y + dy) for x, y in last for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
        last = [p for p in found if p not in ring and 0 <= p[0] < w and 0 <= p[1] < h and img[p[1]][p[0]] == GREY]
        ring.update(dict.fromkeys(last, r))
    return {(y * w + x, r) for (x, y), r in ring.items() if r}


@pytest.mark.parametrize("limit", [1, 3, 40])
def test_peel(raster, limit):
    rng = random.Random(limit)
    imgs = {k: [[rng.choice([GREY, GREY, GREY, RED]) if 0 < x < 15 and 0 < y < 11 else CLEAR for x in range(16)] for y in range(12)] for k in (1, 2)}
    imgs[3] = [[RED] * 4] * 4
    px = raster(imgs)
    got = peeling.peel(px, px.where("a = 0"), F.col("r") == 232, limit).collect()
    for k, img in imgs.items():
        assert {(r.idx, r.ring) for r in got if r.asset_id == k} == peel_brute(img, limit)
    assert len(got) == len({(r.asset_id, r.idx) for r in got})


def test_peel_stops_at_its_limit(raster):
    img = [[CLEAR] + [GREY] * 60]
    px = raster({1: img})
    got = peeling.peel(px, px.where("a = 0"), F.col("r") == 232, peeling.SPILL_RINGS)
    assert sorted(r.ring for r in got.collect()) == list(range(1, 41))
    assert peeling.clear_peeled(px, got).where("a = 0").count() == 41


def drift_brute(img, s, phase, n):
    h, w = len(img), len(img[0])
    rad = min(3, s // 2)
    delta = lambda p, q: sum(abs(a - b) for a, b in zip(p, q))
    out = {}
    for axis in "xy":
        at = (lambda x, y: img[y][x]) if axis == "x" else (lambda x, y: img[x][y])
        for line in range(n):
            before = 0
            for i in range(1, n):
                nominal = phase + i * s
                score = {o: sum(delta(at(nominal + o - 1, c), at(nominal + o, c)) for c in range(phase + line * s, phase + (line + 1) * s)) for o in range(-rad, rad + 1)}
                best, top = 0, score[0] * 100
                for o in range(-rad, rad + 1):
                    if abs(o) < s and score[o] * 100 - 12 * abs(o - before) > top:
                        best, top = o, score[o] * 100 - 12 * abs(o - before)
                before = min(max(best, before - s + 1), s - 1)
                out[axis, line, i] = before
    return out


@pytest.mark.parametrize("scale, phase, seed", [(4, 1, 1), (5, 2, 2), (3, 0, 3), (2, 1, 4)])
def test_drift_plan(spark, raster, scale, phase, seed):
    img = blocks(24, 24, scale, phase + 1, seed)
    n = (24 - phase) // scale
    grid = spark.createDataFrame([(1, scale, phase, phase, n, n)], drift.GRID)
    plan = drift.plan_boundaries(raster({1: img}), grid)
    assert {(r.axis, r.line, r.i): r.offset for r in plan.collect()} == drift_brute(img, scale, phase, n)
    report = drift.drift_report(plan, grid).first()
    assert report.used == (report.moved > 0)


def test_drift_leaves_a_true_grid_alone(spark, raster):
    grid = spark.createDataFrame([(1, 4, 0, 0, 6, 6)], drift.GRID)
    r = drift.drift_report(drift.plan_boundaries(raster({1: blocks(24, 24, 4, 0, 7)}), grid), grid).first()
    assert (r.used, r.moved, r.max_offset, r.mean_offset) == (False, 0, 0, 0.0)


def test_sobel_finds_the_scale(raster):
    votes = sobel.sobel_votes(raster({8: blocks(96, 96, 8, 0, 1), 6: blocks(96, 96, 6, 0, 2), 1: [[RED] * 64] * 64}))
    best = {r.asset_id: r.top_scale for r in votes.select("asset_id", "top_scale").distinct().collect()}
    assert best[8] % 8 == 0 and best[6] % 6 == 0 and 1 not in best
    assert sobel.votes_for_grid(raster({1: blocks(32, 32, 4, 0, 1)})).count() == 0


def test_background_kinds(raster):
    board = [[(240, 240, 240, 255) if (x // 8 + y // 8) % 2 == 0 else (200, 200, 200, 255) for x in range(48)] for y in range(48)]
    halves = [[(210, 60, 60, 255) if x < 24 else (60, 60, 210, 255) for x in range(48)] for y in range(48)]
    got = {r.asset_id: r for r in background.background_model(raster({1: [[RED] * 48] * 48, 2: board, 3: halves, 4: [[CLEAR] * 48] * 48})).collect()}
    assert (got[1].kind, got[1].first, got[1].threshold) == ("solid", 200 << 16 | 30 << 8 | 40, 0.02)
    assert (got[2].kind, got[2].cell, got[2].phase_x % 8, got[2].phase_y % 8, got[2].score) == ("checkerboard", 8, 0, 0, 1.0)
    assert got[3].kind == "multi" and got[3].second is not None
    assert (got[4].kind, got[4].confidence) == ("solid", 0.0)


def test_depth_is_city_block_distance(raster):
    rng = random.Random(9)
    img = [[CLEAR if rng.random() < 0.08 else RED for _ in range(17)] for _ in range(13)]
    out = [(x, y) for y in range(13) for x in range(17) if img[y][x][3] == 0]
    got = outline_candidates.depth_from(raster({1: img, 2: [[RED] * 3] * 3}), F.col("a") == 0).collect()
    for r in got:
        assert r.depth == (min(abs(r.x - x) + abs(r.y - y) for x, y in out) if r.asset_id == 1 else None)


def test_outline_is_told_from_fill(raster):
    img = [[CLEAR if max(abs(x - 12), abs(y - 12)) > 9 else (15, 15, 20, 255) if max(abs(x - 12), abs(y - 12)) == 9 else (220, 150, 60, 255) for x in range(25)] for y in range(25)]
    got = outline_candidates.outline_candidates(raster({1: img})).collect()
    assert [(r.rank, r.color, r.label) for r in got] == [(1, 15 << 16 | 15 << 8 | 20, "deliberate")]
    assert (got[0]["count"], got[0].interior) == (72, 0)


def test_restore_counts_pixels_restored_before(raster):
    light = (200, 180, 160, 255)
    soft = (200, 180, 160, 60)
    source = [[light, soft, soft, soft], [CLEAR] * 4]
    image = [[CLEAR] * 4, [CLEAR] * 4]
    got = {r.idx: (r.a, r.by) for r in subject.restore_subject(raster({1: image}), raster({1: source})).collect()}
    assert got == {i: (255, "restored") for i in range(4)} | {i: (0, None) for i in range(4, 8)}
    back = [row[::-1] for row in source]
    got = {r.idx: r.a for r in subject.restore_subject(raster({1: image}), raster({1: back})).collect()}
    assert got == {3: 255} | {i: 0 for i in (0, 1, 2, 4, 5, 6, 7)}  # to the left nothing was opaque when its turn came


def test_other_sizes_stay_as_they_are(raster):
    px = raster({1: [[RED, CLEAR]]})
    for fn in (subject.restore_subject, subject.clear_residual, subject.clip_to_source):
        assert {(r.idx, r.r, r.a, r.by) for r in fn(px, raster({1: [[RED], [RED]]})).collect()} == {(0, 200, 255, None), (1, 0, 0, None)}


def test_nearest_outline_by_brute_force(raster):
    rng = random.Random(11)
    img = [[(20, 24, 40, 255) if rng.random() < 0.06 else RED for _ in range(23)] for _ in range(19)]
    on = [(x, y) for y in range(19) for x in range(23) if img[y][x][0] == 20]
    for r in grey_shell.nearest_outline(raster({1: img}).withColumn("on", F.col("r") == 20)).collect():
        near = [((x - r.x) ** 2 + (y - r.y) ** 2, y, x) for x, y in on if abs(x - r.x) <= 4 and abs(y - r.y) <= 4]
        assert (r.oy, r.ox) == (min(near)[1:] if near else (None, None))


def test_object_before_a_gradient(raster):
    def img(obj):
        return [[(200, 40, 30, 255) if obj and 12 <= x < 24 and 10 <= y < 22 else (100 + 3 * x, 100 + 3 * x, 120, 255) for x in range(40)] for y in range(32)]

    half = [[(30, 30, 30, 255) if x < 20 else (220, 220, 220, 255) for x in range(40)] for _ in range(32)]
    got = {r.asset_id: r for r in foreground.foreground_evidence(raster({1: img(True), 2: img(False), 3: half})).collect()}
    assert (got[1].gradient, got[1].single, got[1].foreground, got[1].coverage) == (True, True, 0.1125, 0.1125)
    assert (got[2].gradient, got[2].single, got[2].foreground) == (True, False, 0.0)
    assert not got[3].gradient and not got[3].single
