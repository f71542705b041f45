"""Sheet layout from pixels, and bulk edits of frames, rows and clips."""

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.corpus_sql import ANIMATIONS, FRAMES, PX_PART, PX_SHEET
from gridloom.catalog.frame_queries import CF, FX, ROWS, fx, rows as frame_rows
from gridloom.operators import frame_edits as E
from gridloom.operators import frames as R
from gridloom.operators import sheets as S
from gridloom.session import cut_lineage
from gridloom.sources import corpora
from gridloom.sources.tables import table

# corner pixels of the sheet collection are clear, so the background is transparent black
_FG = "fgp AS (SELECT *, r+g+b+a>42 AS fg FROM px_sheet)"


def bands_sql(src: str, keys: str, gap: int, least: int, name: str) -> str:
    return f"""{name} AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY st)-1 AS band, st, en FROM (SELECT {keys}, isl, min(pos) AS st, max(pos) AS en FROM (
      SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY pos) AS isl FROM (SELECT *, CASE WHEN pos-lag(pos) OVER (PARTITION BY {keys} ORDER BY pos)<={gap}+1 THEN 0 ELSE 1 END AS nw FROM {src})) GROUP BY {keys}, isl) WHERE en-st+1>={least})"""


BANDS = f"{_FG}, rc AS (SELECT asset_id, y AS pos, count(*) AS n FROM fgp WHERE fg GROUP BY 1,2 HAVING count(*)>=4), {bands_sql('rc','asset_id',3,12,'bd')}"
SEGS = f"""{BANDS}, sc AS (SELECT p.asset_id, band AS row, x AS pos, count(*) AS n FROM fgp p JOIN bd ON bd.asset_id=p.asset_id AND p.y BETWEEN st AND en WHERE fg GROUP BY 1,2,3, en, st HAVING count(*)>=greatest(2, floor((en-st+1)*0.08e0))), {bands_sql('sc','asset_id, row',1,12,'sb')},
 seg AS (SELECT asset_id, row, band AS seg, st AS x, en-st+1 AS w FROM sb)"""


@query("w04_row_bands", f"WITH {PX_SHEET}, {BANDS} SELECT asset_id, band, st AS start, en AS end FROM bd".replace("AS end", 'AS "end"'))
def w04(spark, d):
    return S.row_bands(S.foreground(corpora.px_sheet(spark, d)))


def _segments(spark, d):
    fg = S.foreground(corpora.px_sheet(spark, d))
    return S.segments(fg, S.row_bands(fg))


@query("w04_segments", f"WITH {PX_SHEET}, {SEGS} SELECT * FROM seg")
def w04s(spark, d):
    return _segments(spark, d)


STATS = """g0 AS (SELECT *, x-lag(x) OVER q AS sg, CASE WHEN lag(x) OVER q IS NOT NULL THEN greatest(0,x-lag(x+w) OVER q) END AS gp, row_number() OVER q - 1 AS i FROM seg WINDOW q AS (PARTITION BY asset_id,row ORDER BY x)),
 g1 AS (SELECT asset_id, row, count(*) AS n, coalesce(floor(quantile_cont(gp,0.5)+0.5e0),0)::BIGINT AS gap, greatest(1,coalesce(floor(quantile_cont(sg,0.5)+0.5e0),0))::BIGINT AS pitch FROM g0 GROUP BY 1,2),
 g2 AS (SELECT asset_id, row, greatest(0,floor(quantile_cont(x-i*pitch,0.5)+0.5e0))::BIGINT AS grid_start FROM g0 JOIN g1 USING (asset_id,row) GROUP BY 1,2),
 ss AS (SELECT g1.asset_id, g1.row, n, gap, pitch, grid_start, drift FROM g1 JOIN g2 USING (asset_id,row) JOIN (SELECT asset_id, row, max(abs(x-grid_start-i*pitch)) AS drift FROM g0 JOIN g1 USING (asset_id,row) JOIN g2 USING (asset_id,row) GROUP BY 1,2) USING (asset_id,row))"""


@query("w05_segment_pitch", f"WITH {PX_SHEET}, {SEGS}, {STATS} SELECT * FROM ss")
def w05(spark, d):
    return S.segment_stats(_segments(spark, d))


@query("h01_sheet_layout", f"""WITH {PX_SHEET}, {SEGS}, r AS (SELECT asset_id, row, count(*) AS n FROM seg GROUP BY 1,2), md AS (SELECT asset_id, row, floor(quantile_cont(w,0.5)+0.5e0) AS mw FROM seg GROUP BY 1,2), g0 AS (SELECT asset_id, row, x, greatest(w,mw) AS w, CASE WHEN lag(x) OVER z IS NOT NULL THEN greatest(0,x-lag(x+w) OVER z) END AS gp FROM seg JOIN md USING (asset_id,row) WINDOW z AS (PARTITION BY asset_id,row ORDER BY x)),
 k AS (SELECT asset_id, count(DISTINCT row) AS rows, floor(quantile_cont(w,0.5)+0.5e0)::BIGINT AS frame_w, min(x) AS margin, coalesce(floor(quantile_cont(gp,0.5)+0.5e0),0)::BIGINT AS spacing FROM g0 GROUP BY 1),
 m AS (SELECT asset_id, max(n) AS columns, min(n) AS fewest FROM r GROUP BY 1), h AS (SELECT asset_id, floor(quantile_cont(en-st+1,0.5)+0.5e0)::BIGINT AS frame_h FROM bd GROUP BY 1)
 SELECT k.asset_id, rows, columns, frame_w, frame_h, margin, spacing, round(CASE WHEN rows>=2 AND columns>=2 THEN greatest(0.2e0,least(0.96e0,0.52e0+least(0.24e0,rows*0.06e0)+least(0.2e0,columns*0.04e0))) ELSE 0.4e0 END,6) AS confidence,
  CASE WHEN fewest<columns THEN 'uneven-rows' ELSE '' END AS warnings FROM k JOIN m USING (asset_id) JOIN h USING (asset_id)""")
def h01(spark, d):
    return S.sheet_layout(S.sheet_rows(corpora.px_sheet(spark, d))).drop("hs", "drift", "merged")


@query("h01_layout_frames")
def h01f(spark, d):
    r = S.sheet_rows(corpora.px_sheet(spark, d))
    return S.layout_frames(r, S.sheet_layout(r))


@query("h02_merged_segments")
def h02(spark, d):
    """Split every cell in two parts, then merge the parts back into frames."""
    px = corpora.px_sheet(spark, d)
    fg = S.foreground(px)
    seg = S.segments(fg, S.row_bands(fg))
    parts = seg.withColumn("p", F.explode(F.array(F.struct(F.col("x").alias("x"), F.floor(F.col("w") / 2 - 1).alias("w")), F.struct((F.col("x") + F.floor(F.col("w") / 2) + 1).alias("x"), F.floor(F.col("w") / 2 - 1).alias("w")))))
    r = S.row_arrays(parts.select("asset_id", "row", "p.x", "p.w")).withColumn("img_w", F.lit(96).cast("long"))
    out = S.fit_drift(cut_lineage(S.merge_groups(cut_lineage(S.merge_effects(cut_lineage(r))))))
    return out.select("asset_id", "row", "merged_count", "drift", F.to_json("s").alias("segments"))


@query("h04_row_normalise")
def h04(spark, d):
    r = S.sheet_rows(corpora.px_sheet(spark, d))
    return r.select("asset_id", "row", "start", "end", "merged_count", "drift", F.to_json("s").alias("segments"))


@query("h05_prefer_regular", "WITH k AS (SELECT p_partkey AS asset_id, (p_size%10)/10e0 AS c, 4+p_size%8 AS f, (p_partkey%11)/11e0 AS rc, 6+p_partkey%9 AS rf FROM part) SELECT asset_id, CASE WHEN rc<0.7e0 OR (c>=rc+0.08e0 AND f>=rf*0.5e0) THEN 'bands' ELSE 'regular' END AS choice, round(CASE WHEN rc<0.7e0 OR (c>=rc+0.08e0 AND f>=rf*0.5e0) THEN c ELSE rc END,6) AS confidence FROM k")
def h05(spark, d):
    p = table(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    det = p.select(k.alias("asset_id"), (s % 10 / 10.0).alias("confidence"), (s % 8 + 4).alias("frames"))
    reg = p.select(k.alias("asset_id"), (k % 11 / 11.0).alias("confidence"), (k % 9 + 6).alias("frames"))
    return S.prefer_layout(det, reg).withColumn("confidence", F.round("confidence", 6))


@query("h06_layout_confidence")
def h06(spark, d):
    return S.layout_confidence(S.sheet_rows(corpora.px_sheet(spark, d), centre=True))


@query("h06_row_confidence")
def h06r(spark, d):
    r = S.sheet_rows(corpora.px_sheet(spark, d))
    return S.row_confidence(r, S.sheet_layout(r))


@query("a26_atlas_occupancy")
def a26(spark, d):
    return S.atlas_occupancy(corpora.px_sheet(spark, d), (2, 3), (3, 5), 8)


def _holes(spark, d):
    px = corpora.px_sheet(spark, d)
    step = F.col("asset_id") % 3 + 6
    return px.withColumn("a", F.when((F.col("x") % step == 2) | (F.col("y") % step == 1), 0).otherwise(255).cast("long"))


_SEP = lambda pos, size, tag: f"""l_{tag} AS (SELECT asset_id, {pos} AS pos FROM hp GROUP BY 1,2 HAVING count(*) FILTER (a<=16)>=greatest(4,ceil({size}*0.86e0))), i_{tag} AS (SELECT *, pos-lag(pos) OVER (PARTITION BY asset_id ORDER BY pos) AS pitch FROM l_{tag}),
 b_{tag} AS (SELECT asset_id, pitch, count(*) AS k, min(pos) AS f FROM i_{tag} WHERE pitch BETWEEN 4 AND 128 GROUP BY 1,2), p_{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY k DESC, f) AS rn FROM b_{tag}) WHERE rn=1), n_{tag} AS (SELECT asset_id, count(*) AS n FROM l_{tag} GROUP BY 1)"""


@query("a39_separator_grid", f"""WITH {PX_SHEET}, hp AS (SELECT * EXCLUDE (a), CASE WHEN x%(6+asset_id%3)=2 OR y%(6+asset_id%3)=1 THEN 0 ELSE 255 END AS a FROM px_sheet), {_SEP('x',64,'c')}, {_SEP('y',96,'r')}
 SELECT asset_id, p_c.pitch-1 AS tile_w, p_r.pitch-1 AS tile_h, n_r.n-1 AS rows, n_c.n-1 AS columns FROM p_c JOIN n_c USING (asset_id) JOIN p_r USING (asset_id) JOIN n_r USING (asset_id) WHERE n_c.n>=5 AND n_r.n>=5 AND p_c.k>=greatest(3,floor((n_c.n-1)*0.75e0)) AND p_r.k>=greatest(3,floor((n_r.n-1)*0.75e0))""")
def a39(spark, d):
    return S.separator_grid(_holes(spark, d))


@query("a31_sheet_conditioning", f"""WITH {PX_SHEET}, d AS (SELECT *, a>0 AND r+g+b>42 AS fg FROM px_sheet), q AS (SELECT *, fg AND r+g+b>=504 AND greatest(r,g,b)-least(r,g,b)<=52 AS mk FROM d),
 g AS (SELECT asset_id, count(*) AS px, count(DISTINCT (r*65536+g*256+b)*256+a) AS exact_colors, count(DISTINCT (r//8)*1024+(g//8)*32+b//8) FILTER (fg) AS bins, count(*) FILTER (fg) AS f, count(*) FILTER (a>0 AND a<255) AS soft, count(*) FILTER (mk) AS marks FROM q GROUP BY 1)
 SELECT asset_id, exact_colors, bins, round(f::DOUBLE/px,6) AS foreground, soft, marks, array_to_string(list_filter([CASE WHEN exact_colors>3 THEN 'excessive-exact-colors' END, CASE WHEN bins>2 THEN 'dense-coarse-palette' END, CASE WHEN marks>=60 AND marks::DOUBLE/f BETWEEN 0.015e0 AND 0.22e0 THEN 'caption-bracket-ignored' END], lambda v: v IS NOT NULL), ',') AS issues FROM g""")
def a31(spark, d):
    return S.conditioning(corpora.px_sheet(spark, d), 3, 2, 0.18, 32).drop("matte")


_TG = "tg AS (SELECT asset_id, row, 1+(asset_id+row)%4 AS target FROM (SELECT DISTINCT asset_id, row FROM rw) WHERE asset_id%3=0)"
_NEW = "'row_'||(row+1)||'_'||lpad(col::VARCHAR,3,'0')"


@query("h13_set_row_counts", f"""WITH {FRAMES}, {ROWS}, {_TG}, n AS (SELECT asset_id, row, count(*) AS n, arg_max(name,col) AS last FROM rw GROUP BY 1,2)
 SELECT rw.asset_id, rw.row, col, name, false AS inserted, '' AS template FROM rw LEFT JOIN tg USING (asset_id,row) WHERE target IS NULL OR col<target
 UNION ALL SELECT asset_id, row, col, {_NEW}, true, last FROM n JOIN tg USING (asset_id,row), (SELECT range AS col FROM range(5)) WHERE col>=n AND col<target""")
def h13(spark, d):
    r = frame_rows(spark, d)
    t = r.select("asset_id", "row").distinct().filter("asset_id % 3 = 0").withColumn("target", (F.col("asset_id") + F.col("row")) % 4 + 1)
    return E.set_row_counts(r, t)


@query("h13_fill_sparse_rows", f"""WITH {FRAMES}, {ROWS}, n AS (SELECT asset_id, row, count(*) AS n, arg_max(name,col) AS last FROM rw GROUP BY 1,2), m AS (SELECT *, max(n) OVER (PARTITION BY asset_id) AS target FROM n)
 SELECT asset_id, row, col, name, false AS inserted, '' AS template FROM rw UNION ALL SELECT asset_id, row, col, {_NEW}, true, last FROM m, (SELECT range AS col FROM range(5)) WHERE col>=n AND col<target""")
def h13f(spark, d):
    return E.fill_sparse_rows(frame_rows(spark, d))


@query("h13_row_insert_remove", f"""WITH {FRAMES}, {ROWS}, l AS (SELECT asset_id, max(row) AS last FROM rw GROUP BY 1), e AS (SELECT asset_id, last, ['insert_before','insert_after','remove','none'][1+asset_id%4] AS op, asset_id%2 AS at_ FROM l),
 j AS (SELECT rw.*, op, at_, last FROM rw JOIN e USING (asset_id))
 SELECT asset_id, row+CASE WHEN op='insert_before' AND row>=at_ THEN 1 WHEN op='insert_after' AND row>=at_+1 THEN 1 WHEN op='remove' AND row>at_ AND last>0 THEN -1 ELSE 0 END AS row, col, name FROM j WHERE NOT (op='remove' AND row=at_ AND last>0)
 UNION ALL SELECT asset_id, at_+CASE WHEN op='insert_after' THEN 1 ELSE 0 END, 0, 'row_'||(last+2)||'_000' FROM j WHERE op LIKE 'insert%' AND row=at_ AND col=0""")
def h13r(spark, d):
    r = frame_rows(spark, d)
    ops = F.array(*[F.lit(v) for v in ("insert_before", "insert_after", "remove")])
    e = r.select("asset_id").distinct().filter("asset_id % 4 < 3").select("asset_id", F.element_at(ops, (F.col("asset_id") % 4 + 1).cast("int")).alias("op"), (F.col("asset_id") % 2).alias("at"))
    return E.edit_rows(r, e)


@query("h13_join_rows", f"""WITH {FRAMES}, {ROWS}, k AS (SELECT * FROM rw WHERE row<2), m AS (SELECT asset_id FROM k GROUP BY 1 HAVING count(DISTINCT row)>=2) SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY row, col)-1 AS pos, name FROM k SEMI JOIN m USING (asset_id)""")
def h13j(spark, d):
    r = frame_rows(spark, d)
    return E.join_rows(r, r.filter("row < 2").select("asset_id", "row"))


@query("h13_cell_resize", f"""WITH {FRAMES}, {ROWS}, b AS (SELECT asset_id, row, max(w) AS rw_, max(h) AS rh FROM rw GROUP BY 1,2) SELECT rw.asset_id, rw.row, col, name, greatest(1, CASE WHEN row=0 AND asset_id%2=0 THEN 40 ELSE rw_ END)::BIGINT AS w, greatest(1, CASE WHEN row=0 AND asset_id%2=0 THEN 20 ELSE rh END)::BIGINT AS h FROM rw JOIN b USING (asset_id,row)""")
def h13c(spark, d):
    r = frame_rows(spark, d)
    n = lambda v: F.lit(v).cast("long")
    e = r.filter("row = 0 and asset_id % 2 = 0").select("asset_id", "row").distinct().select("asset_id", "row", n(40).alias("cell_w"), n(20).alias("cell_h"))
    return E.resize_cells(r, e)


@query("h13_scoped_patch", f"""WITH {FRAMES}, {ROWS} SELECT asset_id, row, col, name, (CASE WHEN asset_id%5=0 AND name='f_3' THEN 9 WHEN asset_id%2=0 AND row=1 THEN 4 WHEN asset_id%3=0 THEN 2 ELSE 0 END)::BIGINT AS spacing FROM rw""")
def h13p(spark, d):
    r = frame_rows(spark, d)
    ids = r.select("asset_id").distinct()
    none = lambda t: F.lit(None).cast(t)
    patch = lambda cond, scope, row, name, v: ids.filter(cond).select("asset_id", F.lit(scope).alias("scope"), row.alias("row"), name.alias("name"), F.lit(v).cast("long").alias("spacing"))
    p = patch("asset_id % 3 = 0", "sheet", none("long"), none("string"), 2).unionByName(patch("asset_id % 2 = 0", "row", F.lit(1).cast("long"), none("string"), 4)).unionByName(
        patch("asset_id % 5 = 0", "frame", none("long"), F.lit("f_3"), 9))
    return E.scoped_patch(r, p)


_CL2 = "cl2 AS (SELECT asset_id, 'walk' AS clip, pos, 'walk_'||lpad(pos::VARCHAR,3,'0') AS name FROM cf UNION ALL SELECT asset_id, 'run', pos, 'f_'||pos FROM cf WHERE pos<2 UNION ALL SELECT asset_id, 'run_2', pos, 'g_'||pos FROM cf WHERE pos<1 AND asset_id%2=0)"


def _clips(spark, d):
    c = R.clip_frames(corpora.animations(spark, d)).select("asset_id", F.col("pos").cast("long").alias("pos"))
    p = F.col("pos").cast("string")
    a = c.select("asset_id", F.lit("walk").alias("clip"), "pos", F.format_string("walk_%03d", "pos").alias("name"))
    b = c.filter("pos < 2").select("asset_id", F.lit("run").alias("clip"), "pos", F.concat(F.lit("f_"), p).alias("name"))
    e = c.filter("pos < 1 and asset_id % 2 = 0").select("asset_id", F.lit("run_2").alias("clip"), "pos", F.concat(F.lit("g_"), p).alias("name"))
    return a.unionByName(b).unionByName(e)


_REN = f"""{CF}, {_CL2}, nm AS (SELECT *, CASE WHEN asset_id%3=0 THEN (CASE WHEN asset_id%2=0 THEN 'run_3' ELSE 'run_2' END) WHEN asset_id%3=1 THEN 'dash_now' END AS new FROM cl2),
 rn AS (SELECT asset_id, CASE WHEN clip='walk' AND new IS NOT NULL THEN new ELSE clip END AS clip, pos, CASE WHEN clip='walk' AND new IS NOT NULL THEN new||'_'||lpad(pos::VARCHAR,3,'0') ELSE name END AS name, name AS old_name FROM nm)"""


def _renamed(spark, d):
    clips = _clips(spark, d)
    to = F.when(F.col("asset_id") % 3 == 0, "run").otherwise("  dash now! ")
    r = clips.select("asset_id").distinct().filter("asset_id % 3 < 2").select("asset_id", F.lit("walk").alias("clip"), to.alias("to"))
    return E.rename_clips(clips, r)


@query("h14_rename_clips", f"WITH {ANIMATIONS}, {_REN} SELECT * FROM rn")
def h14(spark, d):
    return _renamed(spark, d)


@query("h14_rename_override_keys", f"WITH {ANIMATIONS}, {_REN}, o AS (SELECT asset_id, name, pos*1e0 AS pivot_x, 1e0 AS pivot_y FROM cl2) SELECT o.asset_id, coalesce(rn.name,o.name) AS name, pivot_x, pivot_y FROM o LEFT JOIN rn ON rn.asset_id=o.asset_id AND rn.old_name=o.name")
def h14k(spark, d):
    o = _clips(spark, d).select("asset_id", "name", F.col("pos").cast("double").alias("pivot_x"), F.lit(1.0).alias("pivot_y"))
    return E.rename_keys(o, _renamed(spark, d))


@query("h14_clip_timing", f"WITH {ANIMATIONS} SELECT asset_id, name, CASE WHEN asset_id%4=0 THEN greatest(1,least(60,asset_id%90)) ELSE fps END AS fps, CASE WHEN asset_id%4=0 THEN false ELSE loop END AS loop, CASE WHEN asset_id%8=0 THEN 'hold' ELSE direction END AS direction FROM animations")
def h14t(spark, d):
    a = corpora.animations(spark, d)
    e = a.filter("asset_id % 4 = 0").select("asset_id", "name", (F.col("asset_id") % 90).alias("fps"), F.lit(False).alias("loop"), F.when(F.col("asset_id") % 8 == 0, "hold").alias("direction"))
    return E.clip_timing(a, e)


@query("h14_clip_from_range", f"""WITH {FRAMES}, n AS (SELECT asset_id, count(*) AS n FROM frames GROUP BY 1), e AS (SELECT *, greatest(0,least(n-1,asset_id%7-1)) AS a, greatest(0,least(n-1,asset_id%5)) AS b FROM n)
 SELECT asset_id, 'cut' AS clip, frame_idx-least(a,b) AS pos, name FROM frames JOIN e USING (asset_id) WHERE frame_idx BETWEEN least(a,b) AND greatest(a,b)""")
def h14r(spark, d):
    f = corpora.frames(spark, d)
    e = f.select("asset_id").distinct().select("asset_id", F.lit("cut").alias("clip"), (F.col("asset_id") % 7 - 1).alias("start_index"), (F.col("asset_id") % 5).alias("end_index"))
    return E.clip_from_range(f, e)


def _source_frames(spark, d):
    return fx(spark, d).withColumn("sx", F.col("x") * 2).withColumn("sy", F.col("y") * 2).withColumn("sw", F.col("w") * 2).withColumn("sh", F.col("h") * 2)


def _deltas(f):
    return f.select("asset_id", "frame_idx", (F.col("asset_id") % 90 - 40).alias("dx"), (F.col("frame_idx") * 13 - 20).alias("dy"), F.lit(2.0).alias("scale"),
                    F.element_at(F.array(*[F.lit(v) for v in ("nw", "se", "e", "s")]), (F.col("asset_id") % 4 + 1).cast("int")).alias("handle"))


_SF = f"{FX}, sf AS (SELECT *, x*2 AS sx, y*2 AS sy, w*2 AS sw, h*2 AS sh, asset_id%90-40 AS dx, frame_idx*13-20 AS dy, ['nw','se','e','s'][1+asset_id%4] AS hd FROM fx)"


@query("h15_move_frames", f"""WITH {FRAMES}, {_SF}, m AS (SELECT *, greatest(0,least(greatest(0,256-sw),sx+dx)) AS nx, greatest(0,least(greatest(0,200-sh),sy+dy)) AS ny FROM sf)
 SELECT asset_id, frame_idx, greatest(0,least(greatest(0,128-w),floor(nx/2e0+0.5e0)))::BIGINT AS x, greatest(0,least(greatest(0,100-h),floor(ny/2e0+0.5e0)))::BIGINT AS y, w, h, nx AS sx, ny AS sy, sw, sh FROM m""")
def h15(spark, d):
    f = _source_frames(spark, d)
    return E.move_frames(f, _deltas(f).drop("handle"), (256, 200), (128, 100))


@query("h15_resize_frames", f"""WITH {FRAMES}, {_SF}, a AS (SELECT *, CASE WHEN hd LIKE '%w%' THEN greatest(0,least(sx+sw-8,sx+dx)) ELSE sx END AS l, CASE WHEN hd LIKE '%n%' THEN greatest(0,least(sy+sh-8,sy+dy)) ELSE sy END AS t FROM sf),
 b AS (SELECT *, CASE WHEN hd LIKE '%e%' THEN greatest(l+8,least(256,sx+sw+dx)) ELSE sx+sw END AS r, CASE WHEN hd LIKE '%s%' THEN greatest(t+8,least(200,sy+sh+dy)) ELSE sy+sh END AS bt FROM a),
 c AS (SELECT *, greatest(0,least(127,floor(l/2e0+0.5e0)))::BIGINT AS ox, greatest(0,least(99,floor(t/2e0+0.5e0)))::BIGINT AS oy, greatest(1,least(128,floor((r-l)/2e0+0.5e0)))::BIGINT AS ow, greatest(1,least(100,floor((bt-t)/2e0+0.5e0)))::BIGINT AS oh FROM b)
 SELECT asset_id, frame_idx, ox AS x, oy AS y, least(ow,greatest(1,128-ox)) AS w, least(oh,greatest(1,100-oy)) AS h, l AS sx, t AS sy, r-l AS sw, bt-t AS sh FROM c""")
def h15r(spark, d):
    f = _source_frames(spark, d)
    return E.resize_frames(f, _deltas(f), (256, 200), (128, 100), 4)


_BX = "bx AS (SELECT asset_id, frame_idx, 'hit' AS id, 2::BIGINT AS x, 3::BIGINT AS y, w-4 AS w, h-5 AS h FROM frames UNION ALL SELECT asset_id, frame_idx, 'hurt', 0, 0, w, h FROM frames WHERE line<4)"


def _boxes(spark, d):
    n = lambda v: F.lit(v).cast("long")
    f = corpora.frames(spark, d)
    a = f.select("asset_id", "frame_idx", F.lit("hit").alias("id"), n(2).alias("x"), n(3).alias("y"), (F.col("w") - 4).alias("w"), (F.col("h") - 5).alias("h"))
    return f, a.unionByName(f.filter("line < 4").select("asset_id", "frame_idx", F.lit("hurt").alias("id"), n(0).alias("x"), n(0).alias("y"), "w", "h"))


@query("h17_metadata_edits", f"""WITH {FRAMES}, {_BX}, e AS (SELECT asset_id, frame_idx, CASE WHEN line=2 THEN 'hit' WHEN line=3 THEN 'hurt' ELSE 'grab' END AS id, CASE WHEN line=3 THEN 'delete' ELSE 'set' END AS op, line*10-15 AS ex, 5 AS ey, 50 AS ew, 4 AS eh FROM frames WHERE line BETWEEN 2 AND 4),
 j AS (SELECT coalesce(bx.asset_id,e.asset_id) AS asset_id, coalesce(bx.frame_idx,e.frame_idx) AS frame_idx, coalesce(bx.id,e.id) AS id, coalesce(ex,x) AS x, coalesce(ey,y) AS y, coalesce(ew,w) AS w, coalesce(eh,h) AS h, op FROM bx FULL JOIN e ON bx.asset_id=e.asset_id AND bx.frame_idx=e.frame_idx AND bx.id=e.id),
 k AS (SELECT j.asset_id, j.frame_idx, id, greatest(0,least(f.w-1,j.x)) AS x, greatest(0,least(f.h-1,j.y)) AS y, j.w AS bw, j.h AS bh, f.w AS fw, f.h AS fh FROM j JOIN frames f USING (asset_id,frame_idx) WHERE op IS NULL OR op<>'delete')
 SELECT asset_id, frame_idx, id, x, y, greatest(1,least(fw-x,bw)) AS w, greatest(1,least(fh-y,bh)) AS h FROM k""")
def h17(spark, d):
    f, b = _boxes(spark, d)
    n = lambda v: F.lit(v).cast("long")
    line = F.col("line")
    e = f.filter(line.between(2, 4)).select("asset_id", "frame_idx", F.when(line == 2, "hit").when(line == 3, "hurt").otherwise("grab").alias("id"), F.when(line == 3, "delete").otherwise("set").alias("op"),
                                            (line * 10 - 15).alias("x"), n(5).alias("y"), n(50).alias("w"), n(4).alias("h"))
    return E.edit_metadata(b, e, f)


@query("h17_copy_metadata", f"""WITH {FRAMES}, {_BX}, c AS (SELECT asset_id, 0 AS s, frame_idx FROM frames WHERE frame_idx=2 AND asset_id%2=0) SELECT * FROM bx ANTI JOIN c USING (asset_id,frame_idx) UNION ALL SELECT c.asset_id, c.frame_idx, id, x, y, w, h FROM c JOIN bx ON bx.asset_id=c.asset_id AND bx.frame_idx=c.s""")
def h17c(spark, d):
    f, b = _boxes(spark, d)
    return E.copy_metadata(b, f.filter("frame_idx = 2 and asset_id % 2 = 0").select("asset_id", F.lit(0).cast("long").alias("source_idx"), "frame_idx"))


@query("h17_default_boxes", f"WITH {FRAMES}, k(id,bx,by_,bw,bh) AS (VALUES ('hit',0.25e0,0.25e0,0.5e0,0.5e0),('hurt',0e0,0e0,1e0,1e0)) SELECT asset_id, frame_idx, id, floor(w*bx+0.5e0)::BIGINT AS x, floor(h*by_+0.5e0)::BIGINT AS y, greatest(1,floor(w*bw+0.5e0))::BIGINT AS w, greatest(1,floor(h*bh+0.5e0))::BIGINT AS h FROM frames, k")
def h17d(spark, d):
    return E.default_boxes(corpora.frames(spark, d), {"hit": (0.25, 0.25, 0.5, 0.5), "hurt": (0, 0, 1, 1)})
