"""Iterative operators against plain Python on small rasters."""

import random

from pyspark.sql import functions as F

from gridloom.operators import components, downsample, histogram, leaders, morphology, outline, quantise

PALETTE = [(10, 10, 10), (200, 30, 40), (205, 36, 44), (40, 190, 60), (250, 250, 245), (90, 90, 200), (96, 84, 196), (12, 14, 9)]


def image(seed, w, h, colors=PALETTE, clear=0.2):
    rnd = random.Random(seed)
    return [[(*rnd.choice(colors), 0 if rnd.random() < clear else 255) for _ in range(w)] for _ in range(h)]


def noisy(seed, w, h):
    rnd = random.Random(seed)
    return [[(rnd.randrange(256), rnd.randrange(256), rnd.randrange(256), 255) for _ in range(w)] for _ in range(h)]


def flat(img):
    return [p for row in img for p in row]


def counts(img):
    out = {}
    for i, (r, g, b, a) in enumerate(flat(img)):
        if a >= 16:
            c = r << 16 | g << 8 | b
            n, f = out.get(c, (0, i))
            out[c] = (n + 1, f)
    return out


def rgb(c):
    return c >> 16 & 255, c >> 8 & 255, c & 255


def median_cut(cnt, budget):
    ranked = sorted(cnt, key=lambda c: (-cnt[c][0], cnt[c][1]))
    if len(ranked) <= budget:
        return ranked
    rng = lambda box: [max(rgb(c)[k] for c in box) - min(rgb(c)[k] for c in box) for k in range(3)]
    boxes = [ranked]
    while len(boxes) < budget:
        can = [b for b in boxes if len(b) > 1 and max(rng(b)) > 0]
        if not can:
            break
        box = min(can, key=lambda b: (-max(rng(b)), -sum(cnt[c][0] for c in b), -len(b), min(cnt[c][1] for c in b)))
        r = rng(box)
        k = 0 if r[0] >= r[1] and r[0] >= r[2] else 1 if r[1] >= r[2] else 2
        order = {0: (0, 1, 2), 1: (1, 0, 2), 2: (2, 0, 1)}[k]
        box2 = sorted(box, key=lambda c: (*[rgb(c)[o] for o in order], cnt[c][1]))
        half, run, cut = sum(cnt[c][0] for c in box2) / 2, 0, 0
        for i, c in enumerate(box2[:-1]):
            run += cnt[c][0]
            if run >= half:
                cut = i + 1
                break
        cut = cut or len(box2) // 2
        boxes.remove(box)
        boxes += [box2[:cut], box2[cut:]]
    boxes.sort(key=lambda b: (-sum(cnt[c][0] for c in b), min(cnt[c][1] for c in b)))
    pal = []
    for b in boxes:
        n = sum(cnt[c][0] for c in b)
        m = [int(sum(rgb(c)[k] * cnt[c][0] for c in b) / n + 0.5) for k in range(3)]
        v = m[0] << 16 | m[1] << 8 | m[2]
        if v not in pal:
            pal.append(v)
    for c in ranked:
        if len(pal) < budget and c not in pal:
            pal.append(c)
    return pal[:budget]


def test_median_cut(spark, raster):
    imgs = {1: noisy(1, 9, 7), 2: image(2, 8, 8), 3: noisy(3, 5, 5), 4: noisy(4, 12, 4)}
    got = {}
    for r in quantise.median_cut(histogram.histogram(raster(imgs)), 6).orderBy("asset_id", "pos").collect():
        got.setdefault(r.asset_id, []).append(r.color)
    assert got == {k: median_cut(counts(v), 6) for k, v in imgs.items()}


def test_palette_invariants(spark, raster):
    imgs = {1: noisy(5, 9, 7), 2: image(6, 8, 8)}
    hist = histogram.histogram(raster(imgs)).cache()
    real = {(r.asset_id, r.color) for r in hist.collect()}
    for fn, exact in ((quantise.perceptual, True), (quantise.variance_cut, False), (quantise.kmeans, False), (quantise.family_first, True)):
        rows = fn(hist, 5).collect()
        for asset in imgs:
            pal = [r.color for r in rows if r.asset_id == asset]
            assert 1 <= len(pal) <= 5 and len(set(pal)) == len(pal)
        if exact:
            assert {(r.asset_id, r.color) for r in rows} <= real


def test_color_leaders_follow_the_scan(spark, raster):
    tol = leaders.denoise_tolerance(30)
    imgs = {1: noisy(7, 10, 10), 2: image(8, 9, 9)}
    want = {}
    for asset, img in imgs.items():
        anchors = []
        for c in sorted(counts(img), key=lambda c: counts(img)[c][1]):
            near = [a for a in anchors if sum((p - q) ** 2 for p, q in zip(rgb(a), rgb(c))) <= tol]
            if not near:
                anchors.append(c)
            want[asset, c] = near[0] if near else c
    got = leaders.color_leaders(histogram.histogram(raster(imgs)), tol)
    assert {(r.asset_id, r.color): r.leader for r in got.collect()} == want


def test_denoise(spark, raster):
    strength, img = 50, image(9, 10, 8)
    tol = leaders.denoise_tolerance(strength)
    px = flat(img)
    anchors, member = [], {}
    for r, g, b, a in px:
        c = r << 16 | g << 8 | b
        if a >= 16 and c not in member:
            near = [q for q in anchors if sum((p - s) ** 2 for p, s in zip(rgb(q), rgb(c))) <= tol]
            if not near:
                anchors.append(c)
            member[c] = near[0] if near else c
    rep = {}
    for lead in anchors:
        mine = [(i, p[:3]) for i, p in enumerate(px) if p[3] >= 16 and member[p[0] << 16 | p[1] << 8 | p[2]] == lead]
        mean = [sum(c[k] for _, c in mine) / len(mine) for k in range(3)]
        rep[lead] = min(mine, key=lambda t: (round(sum((t[1][k] - mean[k]) ** 2 for k in range(3)), 9), t[0]))[1]
    w, h, need = 10, 8, 4
    want = []
    for i, p in enumerate(px):
        if p[3] < 16:
            want.append(p[:3])
            continue
        lead = member[p[0] << 16 | p[1] << 8 | p[2]]
        near = [px[y * w + x] for y in range(max(0, i // w - 1), min(h, i // w + 2)) for x in range(max(0, i % w - 1), min(w, i % w + 2))]
        near = [q for q in near if q[3] >= 16]
        same = sum(member[q[0] << 16 | q[1] << 8 | q[2]] == lead for q in near)
        want.append(rep[lead] if same >= min(need, len(near)) else p[:3])
    got = leaders.denoise(raster({1: img}), strength).orderBy("idx").collect()
    assert [(r.r, r.g, r.b) for r in got] == want


def label(mask, w, h, diag):
    seen, out = {}, {}
    for s in range(w * h):
        if mask[s] is None or s in seen:
            continue
        todo = [s]
        seen[s] = s
        while todo:
            i = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    x, y = i % w + dx, i // w + dy
                    if (dx or dy) and (diag or not (dx and dy)) and 0 <= x < w and 0 <= y < h:
                        j = y * w + x
                        if j not in seen and mask[j] == mask[s]:
                            seen[j] = s
                            todo.append(j)
    return seen


def test_components_4_and_8(spark, raster):
    imgs = {1: image(11, 13, 9, [(0, 0, 0), (255, 0, 0)], 0.3), 2: image(12, 7, 15, [(0, 0, 0)], 0.4)}
    px = raster(imgs)
    for conn in (4, 8):
        got = components.components(px, F.when(F.col("a") > 0, F.col("r")), conn)
        want = {}
        for asset, img in imgs.items():
            mask = [p[0] if p[3] else None for p in flat(img)]
            want.update({(asset, i): c for i, c in label(mask, len(img[0]), len(img), conn == 8).items()})
        assert {(r.asset_id, r.idx): r.component for r in got.select("asset_id", "idx", "component").collect()} == want


def test_snake_component_is_one_part(spark, raster):
    w = h = 15
    on = lambda x, y: y % 2 == 0 or (x == (w - 1 if y % 4 == 1 else 0))
    img = [[(0, 0, 0, 255 if on(x, y) else 0) for x in range(w)] for y in range(h)]
    got = components.components(raster({1: img}), F.when(F.col("a") > 0, 1))
    assert got.select("component").distinct().count() == 1


def test_drop_orphans_and_tiny_parts(spark, raster):
    img = [[(0, 0, 0, 0)] * 8 for _ in range(6)]
    for x, y in [(1, 1), (2, 1), (1, 2), (2, 2), (3, 2), (6, 4), (6, 0), (7, 1)]:
        img[y][x] = (9, 9, 9, 255)
    mask = morphology.alpha_mask(raster({1: img}))
    keep = lambda d: sorted((r.x, r.y) for r in d.filter("m = 1").collect())
    big = [(1, 1), (1, 2), (2, 1), (2, 2), (3, 2)]
    assert keep(outline.drop_orphans(mask, keep_single=True)) == sorted(big + [(6, 0), (7, 1)])
    assert keep(outline.drop_orphans(mask, keep_single=False)) == big
    assert keep(morphology.drop_tiny_components(mask, 2, 8, keep_single=False)) == big
    opened, closed = morphology.opened(mask), morphology.closed(mask)
    assert set(keep(opened)) <= set(keep(mask))
    assert set((x, y) for x, y in keep(mask) if 0 < x < 7 and 0 < y < 5) <= set(keep(closed))


def test_block_k_centroid(spark, raster):
    img = image(15, 12, 8, PALETTE, 0.15)
    cc = downsample.cell_colors(downsample.to_cells(raster({1: img}), F.lit(4).cast("long")))
    got = {(r.cx, r.cy): (r.r, r.g, r.b, r.a) for r in quantise.block_clusters(cc).collect()}
    vec = lambda p: (0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2],) * 1 + (p[0] - (0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]), p[2] - (0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]))
    dist = lambda a, b: round(sum((u - v) ** 2 for u, v in zip(a, b)), 9)
    for (cx, cy), value in got.items():
        block = [img[cy * 4 + j][cx * 4 + i] for j in range(4) for i in range(4)]
        vis = [p for p in block if p[3] >= 16]
        alpha = int(sum(p[3] for p in block) / 16 + 0.5)
        vs = [vec(p) for p in vis]
        lo = min(range(len(vs)), key=lambda i: (vs[i][0], i))
        hi = min(range(len(vs)), key=lambda i: (-vs[i][0], i))
        far = max((i for i in range(len(vs)) if i not in (lo, hi)), key=lambda i: (min(dist(vs[i], vs[lo]), dist(vs[i], vs[hi])), -i))
        cs = [vs[lo], vs[hi], vs[far]]
        for _ in range(6):
            own = [min(range(3), key=lambda k: (dist(v, cs[k]), k)) for v in vs]
            cs = [tuple(sum(v[d] for v, o in zip(vs, own) if o == k) / own.count(k) for d in range(3)) if k in own else cs[k] for k in range(3)]
        best = min(range(3), key=lambda k: (-own.count(k), own.index(k) if k in own else 99))
        mine = [p for p, o in zip(vis, own) if o == best]
        assert value == (*[int(sum(p[k] for p in mine) / len(mine) + 0.5) for k in range(3)], alpha)


def test_canonical_tiles_match_nearest_earlier_leader(spark, raster):
    rnd = random.Random(21)
    base = [[(rnd.randrange(256), rnd.randrange(256), rnd.randrange(256), 255) for _ in range(4)] for _ in range(3)]
    jitter = lambda p: (*[max(0, min(255, v + rnd.randrange(-6, 7))) for v in p[:3]], 255)
    tiles = [[jitter(p) for p in base[rnd.randrange(3)]] for _ in range(16)]
    img = [[tiles[(y // 2) * 4 + x // 2][(y % 2) * 2 + x % 2] for x in range(8)] for y in range(8)]
    mean = lambda a, b: sum(sum((p[k] - q[k]) ** 2 for k in range(3)) ** 0.5 / 441.67295593 * 0.85 for p, q in zip(a, b)) / 4
    leads, want = [], {}
    for i, t in enumerate(tiles):
        near = min(((round(mean(t, tiles[j]), 9), j) for j in leads), default=(9, None))
        if near[0] > 0.02:
            leads.append(i)
            near = (0, i)
        want[i // 4, i % 4] = near[1] // 4 * 8 + near[1] % 4
    got = leaders.canonical_tiles(raster({1: img}), 2, 0.02)
    assert {(r.row, r.col): r.lead_ord for r in got.collect()} == want
