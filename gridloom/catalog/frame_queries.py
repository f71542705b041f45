"""Frames, clips, sheets and manifests on the order collection."""

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.corpus_sql import ANIMATIONS, FRAMES, PX_PART, PX_VEC, rnd
from gridloom.catalog.palette_queries import FIVE, hist_sql, palette_sql
from gridloom.catalog.source_queries import SLICE, slices
from gridloom.operators import frames as R
from gridloom.operators import histogram as H
from gridloom.sources import corpora
from gridloom.sources import manifests as M
from gridloom.sources.tables import table

FX = "fx AS (SELECT *, (frame_idx%4)*32 AS x, (frame_idx//4)*32 AS y FROM frames)"
CF = "cf AS (SELECT asset_id, name AS clip, unnest(frames) AS name, generate_subscripts(frames,1)-1 AS pos FROM animations)"
FI = "fi AS (SELECT asset_id, name, max(frame_idx) AS frame_idx, arg_max(duration_ms, frame_idx) AS duration_ms FROM frames GROUP BY 1,2)"
CO = f"{FRAMES}, {ANIMATIONS}, {CF}, {FI}, co AS (SELECT asset_id, clip, pos, name, fi.frame_idx FROM cf JOIN fi USING (asset_id,name))"


def fx(spark, d):
    f = corpora.frames(spark, d)
    return f.withColumn("x", F.col("frame_idx") % 4 * 32).withColumn("y", F.floor(F.col("frame_idx") / 4) * 32)


def sheets(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("asset_id"), F.lit(128).cast("long").alias("sheet_w"), F.lit(64).cast("long").alias("sheet_h"), (F.col("o_custkey") % 5).alias("colors"))


@query("j04_clip_order", f"WITH {CO} SELECT * FROM co")
def j04(spark, d):
    return R.clip_order(corpora.frames(spark, d), corpora.animations(spark, d))


@query("j04_dangling_frames", f"WITH {CO} SELECT asset_id, clip, pos, name FROM cf ANTI JOIN fi USING (asset_id,name)")
def j04d(spark, d):
    return R.dangling(corpora.frames(spark, d), corpora.animations(spark, d))


RANGE = "rg AS (SELECT a.asset_id, a.name AS clip, coalesce(min(frame_idx),-1) AS start_index, coalesce(max(frame_idx),-1) AS end_index, count(frame_idx) AS n, min(frame_idx-pos) AS oa, max(frame_idx-pos) AS ob FROM animations a LEFT JOIN co ON co.asset_id=a.asset_id AND co.clip=a.name GROUP BY 1,2)"


@query("j04_clip_range", f"WITH {CO}, {RANGE} SELECT asset_id, clip, start_index, end_index, n FROM rg")
def j04r(spark, d):
    return R.clip_range(corpora.frames(spark, d), corpora.animations(spark, d))


@query("j08_override_layering", f"""WITH {CO}, ow AS (SELECT asset_id, name, max(clip) AS clip FROM cf GROUP BY 1,2),
 bf AS (SELECT DISTINCT asset_id, name, 3e0 AS fpx, 5e0 AS fpy, 70000::BIGINT AS fms FROM frames WHERE asset_id%3=0 AND line=2), bc AS (SELECT asset_id, name AS clip, 9e0 AS cpx, 8e0 AS cpy, NULL::BIGINT AS cms FROM animations WHERE asset_id%2=0)
 SELECT f.asset_id, f.frame_idx, f.name, coalesce(fpx,cpx,pivot_x) AS pivot_x, coalesce(fpy,cpy,pivot_y) AS pivot_y, coalesce(greatest(1,least(60000,coalesce(fms,cms))), f.duration_ms) AS duration_ms
 FROM frames f LEFT JOIN ow USING (asset_id,name) LEFT JOIN bf USING (asset_id,name) LEFT JOIN bc ON bc.asset_id=f.asset_id AND bc.clip=ow.clip""".replace("coalesce(greatest(1,least(60000,coalesce(fms,cms))), f.duration_ms)", "CASE WHEN coalesce(fms,cms) IS NULL THEN f.duration_ms ELSE greatest(1,least(60000,coalesce(fms,cms))) END"))
def j08(spark, d):
    f, a = corpora.frames(spark, d), corpora.animations(spark, d)
    by_frame = f.filter("asset_id % 3 = 0 and line = 2").select("asset_id", "name", F.lit(3.0).alias("pivot_x"), F.lit(5.0).alias("pivot_y"), F.lit(70000).cast("long").alias("duration_ms")).distinct()
    by_clip = a.filter("asset_id % 2 = 0").select("asset_id", F.col("name").alias("clip"), F.lit(9.0).alias("pivot_x"), F.lit(8.0).alias("pivot_y"), F.lit(None).cast("long").alias("duration_ms"))
    return R.layer_overrides(f, a, by_frame, by_clip)


@query("j09_missing_exports", f"WITH {FRAMES} SELECT asset_id, frame_idx, name FROM frames ANTI JOIN (SELECT l_orderkey AS asset_id, 'f_'||l_linenumber AS name FROM lineitem WHERE l_returnflag<>'R') e USING (asset_id,name)")
def j09(spark, d):
    li = table(spark, d, "lineitem").filter("l_returnflag <> 'R'")
    exp = li.select(F.col("l_orderkey").alias("asset_id"), F.concat(F.lit("f_"), F.col("l_linenumber").cast("string")).alias("name"))
    return R.missing_exports(corpora.frames(spark, d), exp)


DELTAS = f"""{FRAMES}, md AS (SELECT asset_id, quantile_cont(pivot_x,0.5) AS mpx, quantile_cont(pivot_y,0.5) AS mpy, quantile_cont(w::DOUBLE,0.5) AS mw, quantile_cont(h::DOUBLE,0.5) AS mh, quantile_cont(w/2e0,0.5) AS mcx, quantile_cont(h/2e0,0.5) AS mcy, quantile_cont(duration_ms::DOUBLE,0.5) AS md FROM frames GROUP BY 1),
 dl AS (SELECT asset_id, frame_idx, name, abs(pivot_y-mpy) AS baseline, greatest(abs(pivot_x-mpx),abs(pivot_y-mpy)) AS "pivot", greatest(abs(w-mw),abs(h-mh)) AS frame_size, greatest(abs(w/2e0-mcx),abs(h/2e0-mcy)) AS content_center, abs(duration_ms-md) AS duration FROM frames JOIN md USING (asset_id))"""


@query("a32_stability_deltas", f"WITH {DELTAS} SELECT * FROM dl")
def a32(spark, d):
    return R.stability_deltas(corpora.frames(spark, d))


_ISS = " UNION ALL ".join(f"""SELECT asset_id, '{c}' AS code, '{s}' AS severity, '{u}' AS unit, count(*) AS affected, max("{k}")::DOUBLE AS max_delta FROM dl WHERE "{k}">{t} GROUP BY 1""" for c, s, k, u, t in (
    ("baseline-drift", "warning", "baseline", "px", 1), ("pivot-drift", "warning", "pivot", "px", 1), ("frame-size-variance", "info", "frame_size", "px", 1),
    ("content-center-drift", "warning", "content_center", "px", 1), ("duration-variance", "info", "duration", "ms", 0)))


@query("a32_stability_issues", f"WITH {DELTAS} {_ISS}")
def a32i(spark, d):
    return R.stability_issues(R.stability_deltas(corpora.frames(spark, d)))


@query("a32_stability_summary", f"""WITH {DELTAS} SELECT asset_id, count(*) AS frames, count(*) FILTER (NOT (duration>0 OR greatest(baseline,"pivot",frame_size,content_center)>1)) AS stable, max(baseline) AS max_baseline, max("pivot") AS max_pivot, max(frame_size) AS max_frame_size, max(content_center) AS max_content_center, max(duration) AS max_duration FROM dl GROUP BY 1""")
def a32s(spark, d):
    return R.stability_summary(R.stability_deltas(corpora.frames(spark, d)))


PROBLEMS = f"""{CO}, {FX}, st AS (SELECT o_orderkey AS asset_id, o_custkey%5 AS colors FROM orders), pb AS (SELECT asset_id, 'duplicate-frame' AS code, name AS detail FROM (SELECT asset_id, name, count(*) AS n FROM frames GROUP BY 1,2), range(2,100) t(i) WHERE i<=n
 UNION ALL SELECT asset_id, 'frame-bounds', name FROM fx JOIN st USING (asset_id) WHERE x+w>128 OR y+h>64 UNION ALL SELECT asset_id, 'missing-frame', clip||'/'||name FROM cf ANTI JOIN fi USING (asset_id,name) UNION ALL SELECT asset_id, 'empty-palette', '' FROM st WHERE colors=0)"""


def problems(spark, d):
    return R.validate_manifest(fx(spark, d), corpora.animations(spark, d), sheets(spark, d))


@query("d06_manifest_validation", f"WITH {PROBLEMS} SELECT * FROM pb")
def d06(spark, d):
    return problems(spark, d)


@query("d06_boxes_and_anchors", f"""WITH {FRAMES}, bx AS (SELECT asset_id, frame_idx, 'hit' AS name, line-2 AS x, 0 AS y, w-line%3 AS w, h+1-line%2 AS h, w AS fw, h AS fh FROM frames), an AS (SELECT asset_id, frame_idx, 'hand' AS name, pivot_x+line-3 AS x, pivot_y+line%3 AS y, w AS fw, h AS fh FROM frames)
 SELECT asset_id, frame_idx, 'box-bounds' AS code, name FROM bx WHERE x<0 OR y<0 OR w<1 OR h<1 OR x+w>fw OR y+h>fh UNION ALL SELECT asset_id, frame_idx, 'anchor-bounds', name FROM an WHERE x<0 OR y<0 OR x>fw OR y>fh""")
def d06b(spark, d):
    f = corpora.frames(spark, d)
    line = F.col("line")
    boxes = f.select("asset_id", "frame_idx", F.lit("hit").alias("name"), (line - 2).alias("x"), F.lit(0).alias("y"), (F.col("w") - line % 3).alias("w"), (F.col("h") + 1 - line % 2).alias("h"))
    anchors = f.select("asset_id", "frame_idx", F.lit("hand").alias("name"), (F.col("pivot_x") + line - 3).alias("x"), (F.col("pivot_y") + line % 3).alias("y"))
    return R.validate_boxes(f, boxes, anchors)


_SUM = f"""{PROBLEMS}, al AS (SELECT asset_id, 'error' AS severity FROM pb UNION ALL SELECT asset_id, 'warning' FROM dl0 UNION ALL SELECT asset_id, 'warning' FROM me GROUP BY 1), ct AS (SELECT o_orderkey AS asset_id, coalesce(nf,0) AS frames, 1::BIGINT AS clips, o_custkey%5 AS colors FROM orders LEFT JOIN (SELECT asset_id, count(*) AS nf FROM frames GROUP BY 1) q ON q.asset_id=o_orderkey)"""
_AUX = """dl0 AS (SELECT asset_id FROM frames GROUP BY 1 HAVING max(duration_ms)<>min(duration_ms)), me AS (SELECT asset_id FROM frames ANTI JOIN (SELECT l_orderkey AS asset_id, 'f_'||l_linenumber AS name FROM lineitem WHERE l_returnflag<>'R') e USING (asset_id,name))"""
_SUM = _SUM.replace(f"{FX},", f"{FX}, {_AUX},")


def issue_union(spark, d):
    """Manifest problems, unstable durations and missing frame files as one issue list."""
    f = corpora.frames(spark, d)
    m = problems(spark, d).select("asset_id", F.lit("manifest").alias("code"), F.lit("error").alias("severity"))
    drift = f.groupBy("asset_id").agg(F.min("duration_ms").alias("lo"), F.max("duration_ms").alias("hi")).filter("lo <> hi").select(
        "asset_id", F.lit("duration").alias("code"), F.lit("warning").alias("severity"))
    li = table(spark, d, "lineitem").filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("asset_id"), F.concat(F.lit("f_"), F.col("l_linenumber").cast("string")).alias("name"))
    seq = R.missing_exports(f, li).select("asset_id").distinct().select("asset_id", F.lit("frame-sequence").alias("code"), F.lit("warning").alias("severity"))
    return m.unionByName(drift).unionByName(seq)


@query("u04_issue_union", f"WITH {_SUM} SELECT asset_id, severity, count(*) AS n FROM al GROUP BY 1,2")
def u04(spark, d):
    return issue_union(spark, d).groupBy("asset_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("a34_validation_summary", f"WITH {_SUM} SELECT asset_id, frames, clips, colors, count(*) FILTER (severity='error') AS errors, count(*) FILTER (severity='warning') AS warnings, count(*) FILTER (severity='error')=0 AS ok FROM ct LEFT JOIN al USING (asset_id) GROUP BY 1,2,3,4")
def a34(spark, d):
    n = corpora.frames(spark, d).groupBy("asset_id").agg(F.count(F.lit(1)).alias("frames"))
    counts = sheets(spark, d).select("asset_id", "colors", F.lit(1).cast("long").alias("clips")).join(n, "asset_id", "left").na.fill(0, ["frames"])
    return R.validation_summary(issue_union(spark, d), counts)


@query("u05_distinct_warnings", f"WITH {PROBLEMS} SELECT DISTINCT code, detail FROM pb")
def u05(spark, d):
    return problems(spark, d).select("code", "detail").distinct()


@query("l03_file_list", f"WITH {FRAMES}, n AS (SELECT DISTINCT asset_id, name FROM frames) SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY name) AS ord, name FROM n")
def l03(spark, d):
    from gridloom.operators.ordering import rank_in_chunks

    n = corpora.frames(spark, d).select("asset_id", "name").distinct()
    return rank_in_chunks(n, ["asset_id"], ["name"], ["asset_id"], "ord").select("asset_id", "ord", "name")


@query("d07_engine_warnings", """WITH s AS (SELECT o_orderkey AS asset_id, o_custkey%2 AS extrude, o_orderkey%3 AS sr, o_custkey%4 AS bx, CASE WHEN o_orderkey%5=0 THEN 'tilemap' ELSE 'sprite' END AS ty FROM orders), t AS (SELECT unnest(['godot','unity','phaser','texturepacker','tiled','ldtk']) AS target)
 SELECT asset_id, target, 'engine-'||target||'-'||c AS code, sev AS severity FROM s, t, (VALUES ('extrude-logical-rects','info',1),('source-rect-generic-only','info',2),('gameplay-metadata-generic-only','info',3),('tilemap-inspect-only','warning',4)) v(c,sev,k)
 WHERE CASE k WHEN 1 THEN extrude>0 WHEN 2 THEN sr>0 WHEN 3 THEN bx>0 ELSE ty='tilemap' END""")
def d07(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), (F.col("o_custkey") % 2).alias("extrude"), (F.col("o_orderkey") % 3).alias("source_rects"),
                                         (F.col("o_custkey") % 4).alias("boxes"), F.when(F.col("o_orderkey") % 5 == 0, "tilemap").otherwise("sprite").alias("asset_type"))
    return R.engine_warnings(s)


@query("h11_normalised_packing", f"""WITH {FRAMES}, m AS (SELECT asset_id, max(pivot_x) AS l, max(pivot_y) AS t, max(w-pivot_x) AS r, max(h-pivot_y) AS b, count(*) AS n FROM frames GROUP BY 1), k AS (SELECT *, greatest(1e0,l+r) AS cw, greatest(1e0,t+b) AS ch, greatest(1,least(n,4)) AS cols FROM m)
 SELECT asset_id, frame_idx, name, (2+(frame_idx%cols)*(cw+1))::BIGINT AS x, (2+(frame_idx//cols)*(ch+1))::BIGINT AS y, cw::BIGINT AS w, ch::BIGINT AS h, (l-pivot_x)::BIGINT AS dx, (t-pivot_y)::BIGINT AS dy FROM frames JOIN k USING (asset_id)""")
def h11(spark, d):
    return R.pack_normalised(corpora.frames(spark, d), 4, 2, 1)


@query("w08_onion_skin_wrap", f"""WITH {FRAMES}, q AS (SELECT asset_id, frame_idx, name, count(*) OVER (PARTITION BY asset_id) AS n, lag(name) OVER w AS p, lead(name) OVER w AS x, first_value(name) OVER w AS fv, last_value(name) OVER (PARTITION BY asset_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM frames WINDOW w AS (PARTITION BY asset_id ORDER BY frame_idx))
 SELECT asset_id, frame_idx, name, CASE WHEN n>1 THEN coalesce(p,lv) END AS previous, CASE WHEN n>1 THEN coalesce(x,fv) END AS next FROM q""")
def w08(spark, d):
    return R.onion_skin(corpora.frames(spark, d), True)


@query("w08_onion_skin", f"WITH {FRAMES} SELECT asset_id, frame_idx, name, lag(name) OVER w AS previous, lead(name) OVER w AS next FROM frames WINDOW w AS (PARTITION BY asset_id ORDER BY frame_idx)")
def w08n(spark, d):
    return R.onion_skin(corpora.frames(spark, d), False)


ROWS = "rw AS (SELECT asset_id, frame_idx//3 AS row, frame_idx%3 AS col, name, w, h, duration_ms FROM frames)"


def rows(spark, d):
    return corpora.frames(spark, d).select("asset_id", F.floor(F.col("frame_idx") / 3).alias("row"), (F.col("frame_idx") % 3).alias("col"), "name", "w", "h", "duration_ms")


@query("w09_row_packing", f"""WITH {FRAMES}, {ROWS}, y AS (SELECT asset_id, row, sum(max(h)+2) OVER (PARTITION BY asset_id ORDER BY row)-max(h)-2+4 AS y FROM rw GROUP BY 1,2)
 SELECT asset_id, row, col, name, (sum(w+2) OVER (PARTITION BY asset_id,row ORDER BY col)-w-2+4)::BIGINT AS x, y::BIGINT AS y, w, h FROM rw JOIN y USING (asset_id,row)""")
def w09(spark, d):
    return R.pack_rows(rows(spark, d), 4, 2)


@query("h12_sparse_rows", f"""WITH {FRAMES}, {ROWS}, c AS (SELECT asset_id, row, count(*) AS frame_count FROM rw GROUP BY 1,2), m AS (SELECT *, max(frame_count) OVER (PARTITION BY asset_id) AS target FROM c)
 SELECT asset_id, row, frame_count, target, target-frame_count AS missing FROM m WHERE frame_count<target""")
def h12(spark, d):
    return R.sparse_rows(rows(spark, d).groupBy("asset_id", "row").agg(F.count(F.lit(1)).alias("frame_count")))


@query("h16_manifest_animations", f"""WITH {CO}, g AS (SELECT asset_id, clip, count(*) AS n, count(duration_ms) AS have, string_agg(duration_ms::VARCHAR, ',' ORDER BY pos) AS ms FROM cf LEFT JOIN fi USING (asset_id,name) GROUP BY 1,2)
 SELECT g.asset_id, g.clip, fps, loop, direction, n, CASE WHEN n=have THEN ms END AS durations FROM g JOIN animations a ON a.asset_id=g.asset_id AND a.name=g.clip""")
def h16(spark, d):
    return R.manifest_animations(corpora.frames(spark, d), corpora.animations(spark, d))


_PXF = "pf AS (SELECT p.*, sl.frame_idx, sl.x AS fx, sl.y AS fy, sl.w AS fw, sl.h AS fh FROM px_part p JOIN sl ON sl.asset_id=p.asset_id AND p.x>=sl.x AND p.x<sl.x+sl.w AND p.y>=sl.y AND p.y<sl.y+sl.h)"


@query("j03_pixels_in_frames", f"WITH {PX_PART}, {SLICE}, {_PXF} SELECT asset_id, frame_idx, count(*) AS n, sum(r)::BIGINT AS sr, min(idx) AS first_idx FROM pf GROUP BY 1,2")
def j03(spark, d):
    j = R.frames_at(corpora.px_part(spark, d), slices(spark, d))
    return j.groupBy("asset_id", "frame_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("sr"), F.min("idx").alias("first_idx"))


@query("j03_topmost_frame", f"WITH {PX_PART}, {SLICE} SELECT p.asset_id, idx, max(frame_idx) AS frame_idx FROM px_part p JOIN sl ON sl.asset_id=p.asset_id AND p.x BETWEEN sl.x AND sl.x+sl.w AND p.y BETWEEN sl.y AND sl.y+sl.h GROUP BY 1,2")
def j03t(spark, d):
    return R.topmost_frame(corpora.px_part(spark, d), slices(spark, d))


@query("p14_crop_frames", f"WITH {PX_PART}, {SLICE}, {_PXF} SELECT asset_id, frame_idx, (y-fy)*fw+x-fx AS idx, r, g, b, a FROM pf")
def p14c(spark, d):
    return R.crop_frames(corpora.px_part(spark, d), slices(spark, d)).select("asset_id", "frame_idx", "idx", "r", "g", "b", "a")


@query("p14_scale_nearest", f"WITH {PX_VEC} SELECT p.asset_id, ty*11+tx AS idx, r, g, b FROM (SELECT range AS tx FROM range(11)), (SELECT range AS ty FROM range(5)), px_vec p WHERE p.x=least(7,(tx*8)//11) AND p.y=least(7,(ty*8)//5)")
def p14s(spark, d):
    return R.scale_nearest(corpora.px_vec(spark, d), 11, 5).select("asset_id", "idx", "r", "g", "b")


_DR = lambda v: f"floor(greatest(0e0,least(1e0,{v}))*100e0+0.5e0)/100e0"


@query("a22_palette_drift", f"""WITH {PX_PART}, {SLICE}, {_PXF}, {hist_sql('px_part')}, {palette_sql(4)}, act AS (SELECT DISTINCT asset_id, {FIVE} AS c FROM pal),
 fh AS (SELECT asset_id, frame_idx, r*65536+g*256+b AS color, count(*) AS n, min(idx) AS fi FROM pf WHERE a>=16 GROUP BY 1,2,3), fk AS (SELECT *, count(*) OVER (PARTITION BY asset_id,frame_idx) AS ex, {FIVE} AS c5 FROM fh),
 fm AS (SELECT asset_id, frame_idx, CASE WHEN ex<=4 THEN color ELSE c5 END AS color, sum(n) AS n, min(fi) AS fi, max(ex) AS ex FROM fk GROUP BY 1,2,3), ft AS (SELECT *, row_number() OVER (PARTITION BY asset_id,frame_idx ORDER BY n DESC, fi) AS rk FROM fm),
 fp AS (SELECT DISTINCT asset_id, frame_idx, ex, {FIVE} AS c FROM ft WHERE rk<=4), per AS (SELECT fp.asset_id, frame_idx, max(ex) AS ex, count(*) AS size, count(*) FILTER (act.c IS NULL) AS delta FROM fp LEFT JOIN act ON act.asset_id=fp.asset_id AND act.c=fp.c GROUP BY 1,2),
 g AS (SELECT asset_id, count(*) AS frames, max(ex) AS max_colors, max(delta) AS max_delta, sum(delta)::DOUBLE/count(*) AS ad, min(size) AS lo, max(size) AS hi FROM per GROUP BY 1),
 k AS (SELECT *, CASE WHEN frames>1 THEN (hi-lo)/4e0 ELSE 0e0 END AS va, greatest(max_delta/4e0, greatest(0,max_colors-4)::DOUBLE/greatest(1,max_colors)) AS pr FROM g), z AS (SELECT *, {_DR('round(1e0-least(1e0,pr*0.72e0+va*0.2e0+ad/4e0*0.08e0),9)')} AS st FROM k)
 SELECT asset_id, frames, max_colors, max_delta, floor(ad*100e0+0.5e0)/100e0 AS avg_delta, {_DR('va')} AS variance, {_DR('pr')} AS pressure, st AS stability, CASE WHEN st>=0.82e0 THEN 'stable' WHEN st>=0.62e0 THEN 'review' ELSE 'unstable' END AS label FROM z""")
def a22(spark, d):
    px = corpora.px_part(spark, d)
    return R.palette_drift(px, slices(spark, d), H.frequency_palette(H.histogram(px), 4), 4)


_UF = "uf AS (SELECT asset_id, name, min(frame_idx) AS fi, arg_max(x,frame_idx) AS x, arg_max(y,frame_idx) AS y, arg_max(w,frame_idx) AS w, arg_max(h,frame_idx) AS h, arg_max(pivot_x,frame_idx) AS px, arg_max(pivot_y,frame_idx) AS py, arg_max(duration_ms,frame_idx) AS ms FROM fx GROUP BY 1,2)"
_RC = lambda a, b, c, e: f"'{{\"x\":'||{a}||',\"y\":'||{b}||',\"w\":'||{c}||',\"h\":'||{e}||'}}'"


@query("s08_atlas_json", f"""WITH {FRAMES}, {FX}, {_UF} SELECT asset_id, fi//512 AS page, '{{"frames":{{'||string_agg('"'||name||'":{{"frame":'||{_RC('x','y','w','h')}||',"rotated":false,"trimmed":false,"spriteSourceSize":'||{_RC('0','0','w','h')}||',"sourceSize":{{"w":'||w||',"h":'||h||'}},"pivot":{{"x":'||round(px/w,6)||',"y":'||round(py/h,6)||'}},"duration":'||ms||'}}', ',' ORDER BY fi)||'}}}}' AS json FROM uf GROUP BY 1,2""")
def s08(spark, d):
    return M.atlas_json(fx(spark, d))


@query("s08_atlas_json_trimmed", f"""WITH {FRAMES}, {FX}, {_UF} SELECT asset_id, fi//512 AS page, '{{"frames":{{'||string_agg('"'||name||'":{{"frame":'||{_RC('(x+1)','(y+2)','(w-3)','(h-4)')}||',"rotated":false,"trimmed":true,"spriteSourceSize":'||{_RC('1','2','(w-3)','(h-4)')}||',"sourceSize":{{"w":'||w||',"h":'||h||'}},"pivot":{{"x":'||round(px/w,6)||',"y":'||round(py/h,6)||'}},"duration":'||ms||'}}', ',' ORDER BY fi)||'}}}}' AS json FROM uf GROUP BY 1,2""")
def s08t(spark, d):
    n = lambda v: F.lit(v).cast("long")
    f = fx(spark, d).withColumn("sx", n(1)).withColumn("sy", n(2)).withColumn("sw", F.col("w") - 3).withColumn("sh", F.col("h") - 4)
    return M.atlas_json(f, trim=True)


@query("s13_import_recipe", f"""WITH {FRAMES}, {FX} SELECT asset_id, frame_idx//512 AS page, '['||string_agg('{{"name":"'||name||'","rect":'||{_RC('x','y','w','h')}||',"flippedRect":'||{_RC('x','(64-y-h)','w','h')}||',"pivotNormalized":{{"x":'||round(pivot_x/w,6)||',"y":'||(round(1e0-pivot_y/h,6)+0e0)||'}},"durationMs":'||duration_ms||'}}', ',' ORDER BY frame_idx)||']' AS json FROM fx GROUP BY 1,2""")
def s13(spark, d):
    return M.recipe_json(fx(spark, d), F.lit(64).cast("long"))


TAGS = f"""{RANGE}, tg AS (SELECT rg.asset_id, rg.clip, start_index AS from_index, end_index AS to_index, CASE direction WHEN 'reverse' THEN 'reverse' WHEN 'pingpong' THEN 'pingpong' ELSE 'forward' END AS direction, CASE WHEN n=0 THEN 'empty-animation' WHEN n<>end_index-start_index+1 OR oa<>ob THEN 'non-contiguous-animation' ELSE '' END AS warning FROM rg JOIN animations a ON a.asset_id=rg.asset_id AND a.name=rg.clip)"""


@query("s11_frame_tags", f"WITH {CO}, {TAGS} SELECT * FROM tg")
def s11(spark, d):
    return M.frame_tags(corpora.frames(spark, d), corpora.animations(spark, d))


@query("s11_pivot_slices", f"WITH {FRAMES} SELECT asset_id, frame_idx, name||'_pivot' AS slice, pivot_x, pivot_y FROM frames")
def s11p(spark, d):
    return M.pivot_slices(corpora.frames(spark, d))


def _docs(spark, d):
    f = fx(spark, d).withColumn("rotated", F.col("frame_idx") % 5 == 0)
    return M.project_json(f, M.frame_tags(f, corpora.animations(spark, d)))


@query("s11_project_json", f"""WITH {CO}, {FX}, {TAGS}, t AS (SELECT asset_id, '[{{"name":"'||clip||'","from":'||from_index||',"to":'||to_index||',"direction":"'||direction||'"}}]' AS tags FROM tg WHERE from_index>=0)
 SELECT asset_id, page, '{{"frames":['||body||'],"meta":{{"frameTags":'||coalesce(tags,'[]')||'}}}}' AS json FROM (SELECT asset_id, frame_idx//512 AS page, string_agg('{{"filename":"'||name||'.png","frame":'||{_RC('x','y','w','h')}||',"rotated":'||(frame_idx%5=0)||',"duration":'||duration_ms||'}}', ',' ORDER BY frame_idx) AS body FROM fx GROUP BY 1,2) LEFT JOIN t USING (asset_id)""")
def s11j(spark, d):
    return _docs(spark, d)


@query("s10_project_import", f"""WITH {CO}, {FX}, {TAGS} SELECT fx.asset_id, frame_idx, name, x, y, w, h, duration_ms, CASE WHEN frame_idx BETWEEN from_index AND to_index THEN clip ELSE '' END AS tags, CASE WHEN frame_idx%5=0 THEN 'rotated-frame' ELSE '' END AS warning FROM fx LEFT JOIN tg ON tg.asset_id=fx.asset_id AND from_index>=0""")
def s10(spark, d):
    return M.import_project(_docs(spark, d))


@query("s07_manifest_roundtrip", f"""WITH {FRAMES}, {FX}, {ANIMATIONS}, st AS (SELECT o_orderkey AS asset_id FROM orders) SELECT fx.asset_id, frame_idx//512 AS page, 128::BIGINT AS w, 64::BIGINT AS h, count(*) AS frames, sum(fx.duration_ms)::BIGINT AS ms, any_value(a.name) AS clip, any_value(len(a.frames)) AS clip_len FROM fx JOIN st USING (asset_id) LEFT JOIN animations a USING (asset_id) GROUP BY 1,2""")
def s07(spark, d):
    m = M.read_manifests(M.manifest_json(fx(spark, d), corpora.animations(spark, d), sheets(spark, d)))
    return m.select("asset_id", "page", F.col("m.sheet.w").alias("w"), F.col("m.sheet.h").alias("h"), F.size("m.frames").cast("long").alias("frames"),
                    F.aggregate("m.frames", F.lit(0).cast("long"), lambda acc, f: acc + f["durationMs"]).alias("ms"),
                    F.map_keys("m.animations")[0].alias("clip"), F.size(F.map_values("m.animations")[0]["frames"]).cast("long").alias("clip_len"))


@query("s09_tileset_companion", f"""WITH s AS (SELECT p_partkey AS asset_id, (100+p_size*4)::BIGINT AS sw, (90+p_partkey%50)::BIGINT AS sh, (8+p_size%9)::BIGINT AS fw, (8+p_partkey%5)::BIGINT AS fh, (p_size%3)::BIGINT AS m, (p_partkey%2)::BIGINT AS sp, (10+p_size)::BIGINT AS n, p_size%2 AS odd FROM part)
 SELECT asset_id, '{{"type":"tileset","tilewidth":'||fw||',"tileheight":'||fh||',"spacing":'||sp||',"margin":'||m||',"tilecount":'||n||',"columns":'||((sw-m*2+sp)//(fw+sp))||',"imagewidth":'||sw||',"imageheight":'||sh||'}}' AS json,
  array_to_string(list_filter([CASE WHEN (sw-m*2-fw)%(fw+sp)<>0 THEN 'sheet-width-misaligned' END, CASE WHEN (sh-m*2-fh)%(fh+sp)<>0 THEN 'sheet-height-misaligned' END, CASE WHEN odd>0 THEN 'frame-size-mismatch' END], lambda v: v IS NOT NULL), ',') AS warnings FROM s""")
def s09(spark, d):
    z, k = F.col("p_size").cast("long"), F.col("p_partkey")
    s = table(spark, d, "part").select(k.alias("asset_id"), (z * 4 + 100).alias("sheet_w"), (k % 50 + 90).alias("sheet_h"), (z % 9 + 8).alias("frame_w"), (k % 5 + 8).alias("frame_h"),
                                       (z % 3).alias("margin"), (k % 2).alias("spacing"), (z + 10).alias("frames"), (z % 2).alias("odd_frames"))
    return M.tileset_companion(s)


_TF = ", ".join(f"('{t}','{p}')" for t in ("godot", "tiled", "ldtk") for p in M.TARGET_FILES[t]) + ", ('all','engines/README.md')"


@query("s14_target_files", f"SELECT o_orderkey AS asset_id, target, replace(path,'{{image}}','sheet_'||o_custkey) AS path, CASE WHEN path LIKE '%.json' THEN 'json' ELSE 'text' END AS kind FROM orders, (VALUES {_TF}) t(target,path)")
def s14(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), F.concat(F.lit("sheet_"), F.col("o_custkey").cast("string")).alias("image"))
    return M.target_files(s, ("godot", "tiled", "ldtk"))
