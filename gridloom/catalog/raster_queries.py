"""Stencils, transforms, morphology and components."""

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.alpha_queries import corner_sql
from gridloom.catalog.corpus_sql import PX_PART, PX_TILE, PX_VEC, rnd
from gridloom.catalog.downsample_queries import CL, DOM, cells
from gridloom.functions import color as C
from gridloom.operators import alpha as A
from gridloom.operators import components as K
from gridloom.operators import diagnostics as G
from gridloom.operators import downsample as D
from gridloom.operators import morphology as M
from gridloom.operators import stencil as S
from gridloom.operators import transforms as X
from gridloom.sources import corpora

RW, CW = "q AS (PARTITION BY asset_id,y ORDER BY x)", "v AS (PARTITION BY asset_id,x ORDER BY y)"


@query("j02_neighbour_stencil", f"""WITH {PX_PART}, m AS (SELECT *, CASE WHEN a>=16 THEN 1 ELSE 0 END AS m FROM px_part), h AS (SELECT *, sum(m) OVER (q ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS hs FROM m WINDOW {RW}),
 b AS (SELECT *, sum(hs) OVER (v ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near2, lead(r) OVER q AS rr, lead(r) OVER v2 AS rd FROM h WINDOW {RW}, {CW}, v2 AS (PARTITION BY asset_id,x ORDER BY y))
 SELECT asset_id, idx, near2::BIGINT AS near2, coalesce(abs(r-rr),0) AS step_right, coalesce(abs(r-rd),0) AS step_down FROM b""")
def j02(spark, d):
    px = corpora.px_part(spark, d)
    px = S.box(px, F.when(F.col("a") >= 16, 1).otherwise(0), 2, F.sum, "near2")
    px = S.neighbours4(px, F.col("r"), "n")
    step = lambda s: F.coalesce(F.abs(F.col("r") - F.col(f"n_{s}")), F.lit(0))
    return px.select("asset_id", "idx", "near2", step("r").alias("step_right"), step("d").alias("step_down"))


@query("a18_scene_diagnostics", f"""WITH {PX_PART}, l AS (SELECT *, r*2126+g*7152+b*722 AS l FROM px_part), n AS (SELECT *, lead(l) OVER q AS lr, lead(l) OVER v AS ld FROM l WINDOW {RW}, {CW}),
 g AS (SELECT asset_id, count(*) AS samples, count(DISTINCT (r//8)*1024+(g//8)*32+b//8) AS bins, sum(coalesce(abs(l-lr),0)+coalesce(abs(l-ld),0)) AS step, count(lr)+count(ld) AS probes FROM n GROUP BY 1), k AS (SELECT *, step::DOUBLE/probes/2550000e0 AS den FROM g)
 SELECT asset_id, samples, bins, round(den,6) AS density, CASE WHEN den>=0.22e0 THEN 'high' WHEN den>=0.08e0 THEN 'medium' ELSE 'low' END AS label, CASE WHEN bins<=32 THEN 0e0 ELSE least(1e0,(bins-32)/32e0) END AS palette_risk FROM k""")
def a18(spark, d):
    return G.scene(corpora.px_part(spark, d))


@query("a19_detail_linework", f"""WITH {PX_PART}, l AS (SELECT *, CASE WHEN a>=16 THEN r*299+g*587+b*114 END AS l FROM px_part), n AS (SELECT *, lead(l) OVER q AS lr, lead(l) OVER v AS ld, lag(l) OVER q AS ll, lag(l) OVER v AS lu FROM l WINDOW {RW}, {CW}),
 g AS (SELECT asset_id, count(lr)+count(ld) AS pairs, count(*) FILTER (abs(l-lr)>=36000)+count(*) FILTER (abs(l-ld)>=36000) AS edges, count(*) AS visible, count(*) FILTER (l<72000 AND greatest(lr,ld,ll,lu)-l>=72000) AS dark FROM n WHERE a>=16 GROUP BY 1),
 k AS (SELECT *, coalesce(edges::DOUBLE/nullif(pairs,0),0e0) AS dd, dark::DOUBLE/visible AS dr FROM g) SELECT asset_id, round(dd,6) AS detail_density, round(dr,6) AS dark_line_ratio, dd>=0.08e0 AND dr BETWEEN 0.01e0 AND 0.18e0 AS recommend_contrast FROM k""")
def a19(spark, d):
    return G.detail_linework(corpora.px_part(spark, d))


_L = "r*2126+g*7152+b*722"


@query("x05_contrast_expansion", f"""WITH {PX_TILE}, l AS (SELECT *, {_L} AS l FROM px_tile),
 nb AS (SELECT a.asset_id, a.idx, sum(b.l) AS t, count(*) AS c FROM l a JOIN l b ON a.asset_id=b.asset_id AND abs(a.x-b.x)<=1 AND abs(a.y-b.y)<=1 AND a.idx<>b.idx WHERE b.x BETWEEN a.x-1 AND a.x+1 GROUP BY 1,2),
 f AS (SELECT l.*, l<=640000 AND t-l*c>=560000*c AS dark FROM l JOIN nb USING (asset_id,idx) WHERE (l<=640000 AND t-l*c>=560000*c) OR (l>=2080000 AND l*c-t>=560000*c)),
 cd AS (SELECT p.asset_id, p.idx, f.r AS fr, f.g AS fg, f.b AS fb, row_number() OVER (PARTITION BY p.asset_id,p.idx ORDER BY f.idx DESC) AS rn FROM l p JOIN f ON p.asset_id=f.asset_id AND abs(p.x-f.x)<=1 AND abs(p.y-f.y)<=1 AND p.idx<>f.idx
   WHERE CASE WHEN f.dark THEN p.l-f.l ELSE f.l-p.l END >= 280000)
 SELECT p.asset_id, p.idx, coalesce(fr,r) AS r, coalesce(fg,g) AS g, coalesce(fb,b) AS b FROM px_tile p LEFT JOIN (SELECT * FROM cd WHERE rn=1) c ON c.asset_id=p.asset_id AND c.idx=p.idx""")
def x05(spark, d):
    return X.expand_contrast(corpora.px_tile(spark, d)).select("asset_id", "idx", "r", "g", "b")


def _grn(r, g, b):
    return f"(({g}>=150 AND {r}<=80 AND {b}<=100 AND {g}-{r}>=72 AND {g}-{b}>=56) OR ({g}>=90 AND {r}<=48 AND {b}<=72 AND {g}>{r}*1.8e0 AND {g}>{b}*1.35e0) OR ({g}>=64 AND {r}<=56 AND {b}<=96 AND {g}>={r}+22 AND {g}>={b}-8))"


_SP = "(greatest(r,g,b)-least(r,g,b))"
_KS = ["sn", "so", "sr", "sg", "sb", "sa"]
_win = lambda w, rad, sfx, src: ", ".join(f"sum({src(c)}) OVER ({w} ROWS BETWEEN {rad} PRECEDING AND {rad} FOLLOWING) AS {c}{rad}{sfx}" for c in _KS)
def halo_sql(src: str, size: int | str, name: str = "cm") -> str:
    """CTEs ``d0 .. d10`` over ``src``; the last has the ``action`` and the means ``pr, pg, pb, pa`` and ``bg_*`` it needs."""
    return f"""{corner_sql(src, size, name)}, d0 AS (SELECT p.*, bg_r, bg_g, bg_b, bg_a, round((r-bg_r)*(r-bg_r)+(g-bg_g)*(g-bg_g)+(b-bg_b)*(b-bg_b),6) AS dist, {_SP}<=36 AND r+g+b>=540 AS pale FROM {src} p JOIN {name} USING (asset_id)),
 d1 AS (SELECT *, a<=8 OR dist<=972 AS outs, a>8 AND (CASE WHEN a<220 THEN dist<=6912 OR pale ELSE dist<=6912 END) AS halo, a>8 AND NOT {_grn('bg_r','bg_g','bg_b')} AND {_grn('r','g','b')} AS chroma FROM d0),
 d2 AS (SELECT *, NOT outs AND NOT halo AND NOT chroma AND NOT pale AS subj FROM d1),
 d3 AS (SELECT *, subj::INT AS sn, outs::INT AS so, {', '.join(f'CASE WHEN subj THEN {c} ELSE 0 END AS s{c}' for c in 'rgba')} FROM d2),
 d4 AS (SELECT *, {_win('q', 1, 't', lambda c: c)}, {_win('q', 4, 't', lambda c: c)} FROM d3 WINDOW {RW}),
 d5 AS (SELECT *, {_win('v', 1, 'u', lambda c: c + '1t')}, {_win('v', 4, 'u', lambda c: c + '4t')} FROM d4 WINDOW {CW}),
 d6 AS (SELECT *, bg_a<=8 AND a>=220 AND pale AS wide FROM d5),
 d7 AS (SELECT *, {', '.join(f'(CASE WHEN wide THEN {c}4u ELSE {c}1u END)-{c} AS k{c}' for c in _KS)}, CASE WHEN wide THEN 4 ELSE 1 END AS rad FROM d6),
 d8 AS (SELECT *, {', '.join(rnd(f'ks{c}::DOUBLE/nullif(ksn,0)') + f' AS p{c}' for c in 'rgba')}, x<rad OR y<rad OR x>=w-rad OR y>=h-rad AS rim FROM d7),
 d9 AS (SELECT *, a>=220 AND (CASE WHEN bg_a<=8 THEN ({_SP}<=18 AND r+g+b>=735) OR ({_SP}<=40 AND r+g+b>=620 AND r+g+b<=700) ELSE {_SP}<=18 AND r+g+b>=735 AND dist>972 END) AS detail,
   {_SP}<=32 AND r+g+b>=pr+pg+pb+96 AND (r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb)>5292 AS contr FROM d8),
 d10 AS (SELECT *, CASE WHEN a<=8 OR detail THEN 'keep' WHEN NOT (rim OR kso>0) THEN 'keep' WHEN ksn=0 THEN (CASE WHEN chroma AND bg_a<=8 THEN 'clear' WHEN chroma THEN 'fill' WHEN bg_a<=8 AND pale THEN 'clear' ELSE 'keep' END)
   WHEN halo AND (x=0 OR y=0 OR x=w-1 OR y=h-1) AND dist<=972 THEN 'keep' WHEN NOT halo AND NOT chroma AND NOT contr AND bg_a<=8 AND pale THEN 'clear' WHEN NOT halo AND NOT chroma AND NOT contr THEN 'keep' ELSE 'correct' END AS action FROM d9)"""


_HALO = halo_sql("px_part", 6)


@query("x06_halo_removal", f"""WITH {PX_PART}, {_HALO} SELECT asset_id, idx, action,
 {', '.join(f"(CASE action WHEN 'clear' THEN 0 WHEN 'fill' THEN {rnd('bg_' + c)} WHEN 'correct' THEN p{c} ELSE {c} END)::BIGINT AS {c}" for c in 'rgb')}, (CASE action WHEN 'clear' THEN 0 WHEN 'correct' THEN greatest(a,pa) ELSE a END)::BIGINT AS a FROM d10""")
def x06(spark, d):
    return X.remove_halo(corpora.px_part(spark, d)).select("asset_id", "idx", "action", "r", "g", "b", "a")


_N8 = ", ".join(f"{f} AS n{i}{j}" for i, j, f in [(0, 0, "lag(l0) OVER v"), (0, 1, "lag(k) OVER v"), (0, 2, "lag(r0) OVER v"), (1, 0, "l0"), (1, 2, "r0"), (2, 0, "lead(l0) OVER v"), (2, 1, "lead(k) OVER v"), (2, 2, "lead(r0) OVER v")])
_same = lambda dx, dy: f"coalesce(n{dy+1}{dx+1}=k,false)"


def lines_sql(src: str, high: bool, k: str = "k") -> str:
    """CTEs ``{k}0 .. {k}3`` over ``src``; the last has ``jagged`` and the replacement ``rep`` (packed rgba)."""
    s = _same
    low = f"""CASE WHEN NOT {s(-1,0)} AND NOT {s(1,0)} AND {s(0,-1)}<>{s(0,1)} AND (CASE WHEN {s(0,-1)} THEN {s(-1,-1)} AND {s(1,-1)} ELSE {s(-1,1)} AND {s(1,1)} END) THEN true
      WHEN NOT {s(0,-1)} AND NOT {s(0,1)} AND {s(-1,0)}<>{s(1,0)} AND (CASE WHEN {s(-1,0)} THEN {s(-1,-1)} AND {s(-1,1)} ELSE {s(1,-1)} AND {s(1,1)} END) THEN true ELSE false END"""
    hi = f"""({s(0,-1)}::INT+{s(0,1)}::INT+{s(-1,0)}::INT+{s(1,0)}::INT)=2 AND (({s(-1,0)} AND {s(0,1)} AND {s(1,1)} AND NOT {s(-1,-1)}) OR ({s(1,0)} AND {s(0,-1)} AND {s(-1,-1)} AND NOT {s(1,1)})
      OR ({s(-1,0)} AND {s(0,-1)} AND {s(1,-1)} AND NOT {s(-1,1)}) OR ({s(1,0)} AND {s(0,1)} AND {s(-1,1)} AND NOT {s(1,-1)}))"""
    ring = [f"n{i}{j}" for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    rep = "coalesce(" + ", ".join(f"CASE WHEN {c}<>k AND {c}%256<128 THEN {c} END" for c in reversed(ring)) + ", " + ", ".join(f"CASE WHEN {c}<>k THEN {c} END" for c in ring) + ", 0)"
    return f"""{k}0 AS (SELECT *, r*16777216+g*65536+b*256+a AS k FROM {src}), {k}1 AS (SELECT *, lag(k) OVER q AS l0, lead(k) OVER q AS r0 FROM {k}0 WINDOW {RW}), {k}2 AS (SELECT *, {_N8} FROM {k}1 WINDOW {CW}),
 {k}3 AS (SELECT *, a>=128 AND (({low}){' OR (' + hi + ')' if high else ''}) AS jagged, {rep} AS rep FROM {k}2)"""


def _lines(high: bool) -> str:
    return f"""WITH {PX_VEC}, src AS (SELECT asset_id, idx, x, y, (r//64)*64 AS r, 0 AS g, 0 AS b, CASE WHEN r<64 THEN 0 ELSE 255 END AS a FROM px_vec),
 {lines_sql('src', high)}
 SELECT asset_id, idx, CASE WHEN jagged THEN rep ELSE k END::BIGINT AS rgba, jagged FROM k3"""


def _poster(spark, d):
    px = corpora.px_vec(spark, d)
    zero = F.lit(0).cast("long")
    return px.withColumn("a", F.when(F.col("r") < 64, 0).otherwise(255).cast("long")).withColumn("r", F.col("r").bitwiseAND(192)).withColumn("g", zero).withColumn("b", zero)


def _rgba():
    return (F.col("r") * 16777216 + F.col("g") * 65536 + F.col("b") * 256 + F.col("a")).alias("rgba")


@query("x12_line_cleanup_low", _lines(False))
def x12l(spark, d):
    return X.clean_lines(_poster(spark, d)).select("asset_id", "idx", _rgba(), "jagged")


@query("x12_line_cleanup_high", _lines(True))
def x12h(spark, d):
    return X.clean_lines(_poster(spark, d), high=True).select("asset_id", "idx", _rgba(), "jagged")


@query("x18_outline_padding", f"""WITH {PX_VEC}, {corner_sql('px_vec', 4)}, bg AS (SELECT asset_id, {', '.join(rnd('bg_' + c) + ' AS ' + c for c in 'rgba')} FROM cm), g AS (SELECT range%12 AS x, range//12 AS y FROM range(144))
 SELECT bg.asset_id, g.y*12+g.x AS idx, coalesce(p.r,bg.r) AS r, coalesce(p.g,bg.g) AS g, coalesce(p.b,bg.b) AS b, coalesce(p.a,bg.a) AS a FROM bg CROSS JOIN g LEFT JOIN px_vec p ON p.asset_id=bg.asset_id AND p.x=g.x-2 AND p.y=g.y-2""")
def x18(spark, d):
    px = corpora.px_vec(spark, d)
    m = A.corner_mean(px, A.corner_size(4))
    bg = m.select("asset_id", C.pack(*[C.rnd(F.col(f"bg_{c}")) for c in "rgb"]).alias("color"), C.rnd(F.col("bg_a")).alias("alpha"))
    return X.pad(px, 2, bg).select("asset_id", "idx", "r", "g", "b", "a")


@query("j10_source_lookup", f"""WITH {PX_PART}, {CL}, {DOM} SELECT dom.asset_id, cx, cy, p.idx AS src_idx, p.r*65536+p.g*256+p.b AS src_color, p.a AS src_a FROM dom JOIN (SELECT DISTINCT asset_id, 24//s AS ow FROM px_part) z USING (asset_id)
 JOIN px_part p ON p.asset_id=dom.asset_id AND p.x=least(23, floor((cx+0.5e0)*24/ow)) AND p.y=least(23, floor((cy+0.5e0)*24/ow))""")
def j10(spark, d):
    px = corpora.px_part(spark, d)
    small = D.dominant(D.cell_colors(cells(spark, d)))
    dims = corpora.px_part(spark, d, with_scale=True).groupBy("asset_id").agg(F.floor(F.lit(24) / F.max("s")).alias("w"))
    out = small.join(dims, "asset_id").select("asset_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "w", F.col("w").alias("h"))
    return X.source_lookup(out, px).select("asset_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "src_idx",
                                           C.pack(F.col("src_r"), F.col("src_g"), F.col("src_b")).alias("src_color"), "src_a")


_MASK = "mk AS (SELECT asset_id, idx, x, y, w, h, (a>=128)::INT AS m FROM px_part)"


def _box(src: str, fn: str, out: str, erode: bool) -> str:
    edge = "CASE WHEN x=0 OR y=0 OR x=w-1 OR y=h-1 THEN 0 ELSE k2 END" if erode else "k2"
    return f"""{out} AS (SELECT asset_id, idx, x, y, w, h, {edge} AS m FROM (SELECT *, {fn}(k1) OVER (v ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS k2 FROM (SELECT *, {fn}(m) OVER (q ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS k1 FROM {src} WINDOW {RW}) WINDOW {CW}))"""


@query("x08_morphology_8", f"""WITH {PX_PART}, {_MASK}, {_box('mk','min','er',True)}, {_box('mk','max','di',False)}, {_box('er','max','op',False)}, {_box('di','min','cl_',True)}
 SELECT mk.asset_id, sum(mk.m)::BIGINT AS mask, sum(er.m)::BIGINT AS eroded, sum(di.m)::BIGINT AS dilated, sum(op.m*mk.idx)::BIGINT AS opened, sum(cl_.m*mk.idx)::BIGINT AS closed FROM mk JOIN er USING (asset_id,idx) JOIN di USING (asset_id,idx) JOIN op USING (asset_id,idx) JOIN cl_ USING (asset_id,idx) GROUP BY 1""")
def x08(spark, d):
    m = M.alpha_mask(corpora.px_part(spark, d))
    parts = {"mask": (m, False), "eroded": (M.erode(m), False), "dilated": (M.dilate(m), False), "opened": (M.opened(m), True), "closed": (M.closed(m), True)}
    out = None
    for name, (df, weigh) in parts.items():
        one = df.groupBy("asset_id").agg(F.sum(F.col("m") * F.col("idx") if weigh else F.col("m")).cast("long").alias(name))
        out = one if out is None else out.join(one, "asset_id")
    return out


@query("u06_mask_change", f"""WITH {PX_PART}, {_MASK}, {_box('mk','max','di',False)}, {_box('di','min','cl_',True)}
 SELECT mk.asset_id, count(*) FILTER (mk.m=0 AND cl_.m=1) AS added, count(*) FILTER (mk.m=1 AND cl_.m=0) AS removed FROM mk JOIN cl_ USING (asset_id,idx) GROUP BY 1""")
def u06(spark, d):
    m = M.alpha_mask(corpora.px_part(spark, d))
    return M.mask_change(m, M.closed(m))


_REACH = """RECURSIVE {cte}, k AS (SELECT asset_id, idx, x, y, {key} AS key FROM {src}),
 nb AS (SELECT a.asset_id, a.idx AS i, b.idx AS j FROM k a JOIN k b ON a.asset_id=b.asset_id AND a.key=b.key AND abs(a.x-b.x)+abs(a.y-b.y)=1),
 reach(asset_id, src, idx) AS (SELECT asset_id, idx, idx FROM k WHERE key IS NOT NULL UNION SELECT r.asset_id, r.src, nb.j FROM reach r JOIN nb ON nb.asset_id=r.asset_id AND nb.i=r.idx),
 comp AS (SELECT asset_id, idx, min(src) AS component FROM reach GROUP BY 1,2)"""
_VR = _REACH.format(cte=PX_VEC, src="px_vec", key="CASE WHEN r>=96 THEN r//96 END")


@query("i01_connected_components", f"WITH {_VR} SELECT asset_id, idx, component FROM comp")
def i01(spark, d):
    return K.components(corpora.px_vec(spark, d), F.when(F.col("r") >= 96, F.floor(F.col("r") / 96))).select("asset_id", "idx", "component")


@query("i01_component_sizes", f"WITH {_VR}, s AS (SELECT asset_id, component, count(*) AS size, bool_or(idx%8 IN (0,7) OR idx//8 IN (0,7)) AS touches_edge FROM comp GROUP BY 1,2) SELECT * FROM s")
def i01s(spark, d):
    lab = K.components(corpora.px_vec(spark, d), F.when(F.col("r") >= 96, F.floor(F.col("r") / 96)))
    return K.component_stats(lab).drop("key")


@query("a04_area_weighted_histogram", f"""WITH {_REACH.format(cte=PX_VEC, src="px_vec", key="r//64")}, s AS (SELECT asset_id, key AS color, component, count(*) AS size, min(idx) AS fi FROM comp JOIN k USING (asset_id,idx) GROUP BY 1,2,3),
 b AS (SELECT *, max(size) OVER (PARTITION BY asset_id)>=3 AS any_big FROM s) SELECT asset_id, color*64*65536 AS color, CASE WHEN any_big THEN sum(size*size) FILTER (size>=3) ELSE sum(size) END::BIGINT AS n, CASE WHEN any_big THEN min(fi) FILTER (size>=3) ELSE min(fi) END AS first_idx FROM b GROUP BY asset_id, color, any_big HAVING NOT any_big OR max(size)>=3""")
def a04(spark, d):
    zero = F.lit(0).cast("long")
    px = corpora.px_vec(spark, d).withColumn("r", F.col("r").bitwiseAND(192)).withColumn("g", zero).withColumn("b", zero)
    return K.area_histogram(px, 3)


_FLOOD = """RECURSIVE {pre}, md AS ({model}), mt AS (SELECT p.*, ((r-first//65536)*(r-first//65536)+(g-first//256%256)*(g-first//256%256)+(b-first%256)*(b-first%256)<=972) AS hit FROM px_part p JOIN md USING (asset_id)),
 ext(asset_id, x, y) AS (SELECT asset_id, x, y FROM mt WHERE hit AND (x=0 OR y=0 OR x=23 OR y=23) UNION SELECT m.asset_id, m.x, m.y FROM ext e JOIN (SELECT unnest([1,-1,0,0]) AS dx, unnest([0,0,1,-1]) AS dy) o ON true JOIN mt m ON m.asset_id=e.asset_id AND m.x=e.x+o.dx AND m.y=e.y+o.dy AND m.hit)"""
_MODEL = """SELECT asset_id, floor(sr::DOUBLE/n+0.5e0)::BIGINT*65536+floor(sg::DOUBLE/n+0.5e0)::BIGINT*256+floor(sb::DOUBLE/n+0.5e0)::BIGINT AS first FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, bucket) AS rk FROM (SELECT asset_id, (r//16)*256+(g//16)*16+b//16 AS bucket, sum(t) AS n, sum(r*t) AS sr, sum(g*t) AS sg, sum(b*t) AS sb FROM
  (SELECT *, (y=0 OR y=23)::INT+(x=0 OR x=23)::INT AS t FROM px_part) WHERE t>0 GROUP BY 1,2)) WHERE rk=1"""
_FL = _FLOOD.format(pre=PX_PART, model=_MODEL)


@query("i02_border_flood_fill", f"WITH {_FL} SELECT p.asset_id, p.idx, (CASE WHEN e.x IS NOT NULL THEN 0 WHEN p.a>=128 THEN 255 ELSE 0 END)::BIGINT AS a FROM px_part p LEFT JOIN ext e ON e.asset_id=p.asset_id AND e.x=p.x AND e.y=p.y")
def i02(spark, d):
    px = corpora.px_part(spark, d)
    return K.flood_fill(px, A.border_model(px)).select("asset_id", "idx", "a")


@query("i03_exterior_depth", f"""WITH RECURSIVE {PX_PART}, ext(asset_id, x, y) AS (SELECT asset_id, x, y FROM px_part WHERE a<16 AND (x=0 OR y=0 OR x=23 OR y=23) UNION SELECT m.asset_id, m.x, m.y FROM ext e JOIN (SELECT unnest([1,-1,0,0]) AS dx, unnest([0,0,1,-1]) AS dy) o ON true JOIN px_part m ON m.asset_id=e.asset_id AND m.x=e.x+o.dx AND m.y=e.y+o.dy AND m.a<16),
 d0 AS (SELECT p.asset_id, p.idx, p.x, p.y, CASE WHEN e.x IS NOT NULL THEN 0 END AS dp FROM px_part p LEFT JOIN ext e ON e.asset_id=p.asset_id AND e.x=p.x AND e.y=p.y),
 d1 AS (SELECT *, coalesce(dp, CASE WHEN coalesce(lag(dp) OVER q=0,false) OR coalesce(lead(dp) OVER q=0,false) OR coalesce(lag(dp) OVER v=0,false) OR coalesce(lead(dp) OVER v=0,false) THEN 1 END) AS dq FROM d0 WINDOW {RW}, {CW}),
 d2 AS (SELECT *, coalesce(dq, CASE WHEN coalesce(lag(dq) OVER q=1,false) OR coalesce(lead(dq) OVER q=1,false) OR coalesce(lag(dq) OVER v=1,false) OR coalesce(lead(dq) OVER v=1,false) THEN 2 END, 3) AS dd FROM d1 WINDOW {RW}, {CW})
 SELECT asset_id, idx, dd::BIGINT AS depth FROM d2""")
def i03(spark, d):
    px = corpora.px_part(spark, d)
    return K.exterior_depth(px, K.exterior(px, F.col("a") < 16))


@query("x08_tiny_holes_and_parts", f"""WITH {_REACH.format(cte=PX_VEC, src="px_vec", key="(r>=120)::INT")}, s AS (SELECT asset_id, key, component, count(*) AS size, bool_or(idx%8 IN (0,7) OR idx//8 IN (0,7)) AS te FROM comp JOIN k USING (asset_id,idx) GROUP BY 1,2,3),
 b AS (SELECT *, row_number() OVER (PARTITION BY asset_id, key ORDER BY size DESC, component) AS rk FROM s)
 SELECT asset_id, coalesce(sum(size) FILTER (key=0 AND NOT te AND size<=2),0)::BIGINT AS filled, coalesce(sum(size) FILTER (key=1 AND rk>1 AND size<=2),0)::BIGINT AS removed FROM b GROUP BY 1""")
def x08t(spark, d):
    mask = M.alpha_mask(corpora.px_vec(spark, d).withColumn("a", F.when(F.col("r") >= 120, 255).otherwise(0)))
    filled = M.mask_change(mask, M.fill_tiny_holes(mask, 2)).select("asset_id", F.col("added").alias("filled"))
    return filled.join(M.mask_change(mask, M.drop_tiny_components(mask, 2, 4, False)).select("asset_id", "removed"), "asset_id")


@query("x08_mask_artefacts")
def x08a(spark, d):
    return M.artefacts(M.alpha_mask(corpora.px_vec(spark, d).withColumn("a", F.when(F.col("r") >= 120, 255).otherwise(0))))
