"""Raster and palette sources and sinks, geometry and text columns."""

import uuid

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.corpus_sql import FRAMES, PX_PART, PX_VEC, hex6, rnd
from gridloom.catalog.palette_queries import hist_sql, palette_sql
from gridloom.functions import color as C
from gridloom.functions import geometry as G
from gridloom.functions import text as T
from gridloom.operators import histogram as H
from gridloom.sources import corpora, palette_files, rasters
from gridloom.sources.tables import table


def _images(spark, d):
    img = rasters.assemble_rasters(corpora.px_vec(spark, d)).withColumn("width", F.col("width").cast("int")).withColumn("height", F.col("height").cast("int"))
    bad = F.col("asset_id") % 50 == 0
    return img.withColumn("content", F.when(bad, F.expr("substring(content, 1, 100)")).otherwise(F.col("content")))


@query("s01_raster_explode", f"WITH {PX_VEC} SELECT asset_id, idx, x, y, r, g, b, a FROM px_vec WHERE asset_id%50<>0")
def s01(spark, d):
    return rasters.explode_rasters(_images(spark, d))[0].drop("w", "h")


@query("s01_raster_errors", "SELECT vec_id AS asset_id, 256::BIGINT AS expected_bytes, 100::BIGINT AS actual_bytes FROM embeddings WHERE vec_id%50=0")
def s01e(spark, d):
    return rasters.explode_rasters(_images(spark, d))[1]


@query("s02_raster_assemble", f"""WITH {PX_VEC} SELECT asset_id, 0::BIGINT AS strip, 8::BIGINT AS width, 8::BIGINT AS height, md5(string_agg(printf('%02X%02X%02X%02X', r, g, b, a), '' ORDER BY idx)) AS digest FROM px_vec GROUP BY 1""")
def s02(spark, d):
    s = rasters.assemble_rasters(corpora.px_vec(spark, d))
    return s.select("asset_id", "strip", "width", "height", F.md5(F.hex("content")).alias("digest"))


@query("s03_corpus_sink", f"WITH {PX_VEC} SELECT asset_id, count(*) AS pixels, sum(r)::BIGINT AS sum_r FROM px_vec GROUP BY 1")
def s03(spark, d):
    from gridloom.session import shared_folder

    path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    rasters.write_results(corpora.px_vec(spark, d), path, buckets=8)
    return spark.read.parquet(path).groupBy("asset_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum("r").alias("sum_r"))


_TEXT = {
    "hex": "concat('; part ', p_partkey, chr(10), '#', h1, ' first', chr(10), '// note', chr(10), upper(h2), chr(10), 'nope', chr(10), chr(10), h3)",
    "gpl": "concat('GIMP Palette', chr(10), 'Name: x', chr(10), 'Columns: 8', chr(10), '#', chr(10), c1, ' a', chr(10), '300 1 2', chr(10), c2, chr(10), c3)",
    "pal": "concat('JASC-PAL', chr(10), '0100', chr(10), '3', chr(10), c1, chr(10), '# x', chr(10), c2, chr(10), c3)",
}
_PAL3 = """p3 AS (SELECT p_partkey AS palette_id, unnest([0,1,2])::BIGINT AS pos, unnest([k, k+1, k+2]) AS k FROM (SELECT p_partkey, p_partkey*7+p_size AS k FROM part))"""
_PAL3C = f"{_PAL3}, c3 AS (SELECT palette_id, pos, ((k*47+23)%256)*65536+((k*83+71)%256)*256+(k*131+113)%256 AS c FROM p3)"


def _texts(spark, d, kind):
    k = F.col("p_partkey") * 7 + F.col("p_size")
    p = table(spark, d, "part")
    for i in (1, 2, 3):
        v = k + (i - 1)
        ch = [(v * m + o) % 256 for m, o in ((47, 23), (83, 71), (131, 113))]
        p = p.withColumn(f"h{i}", F.substring(C.hex_of(ch[0] * 65536 + ch[1] * 256 + ch[2]), 2, 6)).withColumn(f"c{i}", F.concat_ws("  ", *[c.cast("string") for c in ch]))
    return p.select(F.col("p_partkey").alias("palette_id"), F.expr(_TEXT[kind]).alias("text"))


_S04 = f"WITH {_PAL3C} SELECT palette_id, pos, {hex6('c')} AS color FROM c3"


@query("s04_hex_palette", _S04)
def s04h(spark, d):
    return palette_files.parse_hex(_texts(spark, d, "hex"))


@query("s04_gimp_palette", _S04)
def s04g(spark, d):
    return palette_files.parse_gimp(_texts(spark, d, "gpl"))


@query("s04_jasc_palette", _S04)
def s04j(spark, d):
    return palette_files.parse_jasc(_texts(spark, d, "pal"))


@query("s04_html_tokens", r"""WITH t AS (SELECT page_id AS palette_id, html, unnest(string_split_regex(html, '\r?\n')) AS raw, generate_subscripts(string_split_regex(html, '\r?\n'),1)-1 AS ln FROM pages),
 u AS (SELECT palette_id, ln, trim(raw) AS line, string_split_regex(trim(raw), '\s+')[1] AS tok FROM t)
 SELECT palette_id, count(*) AS lines, count(*) FILTER (length(line)>0 AND NOT starts_with(line,'//') AND NOT starts_with(line,';') AND regexp_matches(tok,'^#?[0-9a-fA-F]{6}$')) AS colors FROM u GROUP BY 1""")
def s04w(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("palette_id"), F.col("html").alias("text"))
    lines = pages.select("palette_id", F.size(F.split("text", "\r?\n")).cast("long").alias("lines"))
    n = palette_files.parse_hex(pages).groupBy("palette_id").agg(F.count(F.lit(1)).alias("colors"))
    return lines.join(n, "palette_id", "left").na.fill(0, ["colors"])


_PALTXT = f"""WITH {PX_PART}, {hist_sql('px_part')}, {palette_sql(8)}, pq AS (SELECT *, color//65536 AS r, color//256%256 AS g, color%256 AS b, {hex6('color')} AS hx FROM pal),"""


def _part_palette(spark, d):
    pal = H.frequency_palette(H.histogram(corpora.px_part(spark, d)), 8)
    return pal.select(F.col("asset_id").alias("palette_id"), "pos", C.hex_of(F.col("color")).alias("color"))


@query("s05_text_palette_sink", _PALTXT + """ g AS (SELECT asset_id AS palette_id, count(*) AS n, string_agg(hx||chr(10), '' ORDER BY pos) AS hex_text,
  'GIMP Palette'||chr(10)||'Name: '||asset_id||chr(10)||'Columns: 8'||chr(10)||'#'||chr(10)||string_agg(lpad(r::VARCHAR,3,' ')||' '||lpad(g::VARCHAR,3,' ')||' '||lpad(b::VARCHAR,3,' ')||' '||hx||chr(10), '' ORDER BY pos) AS gimp_text,
  'JASC-PAL'||chr(10)||'0100'||chr(10)||count(*)||chr(10)||string_agg(r||' '||g||' '||b||chr(10), '' ORDER BY pos) AS jasc_text, string_agg('"'||hx||'"', ',' ORDER BY pos) AS js FROM pq GROUP BY asset_id)
 SELECT palette_id, hex_text, gimp_text, jasc_text, '{"app":"gridloom","colorCount":'||n||',"colors":['||js||']}' AS json_text,
  '{"schema":"palette-conditioning/v1","colorCount":'||n||',"colors":['||js||'],"strip":{"width":'||n||',"height":1,"swatchSize":1}}' AS conditioning_text FROM g""")
def s05(spark, d):
    return palette_files.write_texts(_part_palette(spark, d))


@query("s06_palette_from_strip", f"WITH {PX_PART}, f AS (SELECT asset_id, r*65536+g*256+b AS color, min(idx) AS fi FROM px_part WHERE a>0 GROUP BY 1,2) SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY fi)-1 AS pos, color FROM f")
def s06(spark, d):
    return rasters.palette_from_strip(corpora.px_part(spark, d))


@query("s06_palette_strip", f"""WITH {PX_PART}, {hist_sql('px_part')}, {palette_sql(8)}, n AS (SELECT asset_id, count(*)*2 AS w FROM pal GROUP BY 1)
 SELECT asset_id, y*w+pos*2+dx AS idx, pos*2+dx AS x, y, color//65536 AS r, color//256%256 AS g, color%256 AS b, 255::BIGINT AS a FROM pal JOIN n USING (asset_id), (SELECT range AS y FROM range(2)), (SELECT range AS dx FROM range(2))""")
def s06p(spark, d):
    pal = H.frequency_palette(H.histogram(corpora.px_part(spark, d)), 8)
    return rasters.palette_strip(pal, 2).drop("w", "h")


@query("s16_synthetic_upscale", f"""WITH {PX_VEC} SELECT asset_id, (y*3+dy+2)*25+(x*3+dx+1) AS idx, x*3+dx+1 AS x, y*3+dy+2 AS y, (CASE WHEN ((x*3+dx+1)*3+(y*3+dy+2)*5)%17=0 THEN least(255,r+1) ELSE r END)::BIGINT AS r, g, b
 FROM px_vec, (SELECT range AS dx FROM range(3)), (SELECT range AS dy FROM range(3))""")
def s16(spark, d):
    return rasters.synth_pixels(corpora.px_vec(spark, d), 3, 1, 2).select("asset_id", "idx", "x", "y", "r", "g", "b")


@query("s16_part_corpus", f"WITH {PX_PART} SELECT asset_id, s, count(*) AS n, sum(r*(idx+1))::BIGINT AS cr, sum(g*(idx+1))::BIGINT AS cg, sum(b*(idx+1))::BIGINT AS cb, sum(a*(idx+1))::BIGINT AS ca FROM px_part GROUP BY 1,2")
def s16c(spark, d):
    px = corpora.px_part(spark, d, with_scale=True)
    return px.groupBy("asset_id", "s").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c) * (F.col("idx") + 1)).alias(f"c{c}") for c in "rgba"])


_BUNDLE = ", ".join(f"('{k}', '{v}')" for k, v in {**palette_files.BUNDLED, **{a: palette_files.BUNDLED[t] for a, t in palette_files.ALIASES.items()}}.items())


@query("s17_palette_dimension", f"""WITH dim(name_key, txt) AS (VALUES {_BUNDLE}), n AS (SELECT p_partkey AS palette_id, ['Pico 8','DB-16','Game Boy','CGA_16','DMG','none','Arcade-8'][1+p_size%7] AS name FROM part),
 j AS (SELECT palette_id, string_split(txt,' ') AS cs FROM n JOIN dim ON name_key=regexp_replace(lower(name),'[^a-z0-9]','','g')) SELECT palette_id, generate_subscripts(cs,1)-1 AS pos, unnest(cs) AS color FROM j""")
def s17(spark, d):
    names = F.array(*[F.lit(v) for v in ("Pico 8", "DB-16", "Game Boy", "CGA_16", "DMG", "none", "Arcade-8")])
    n = table(spark, d, "part").select(F.col("p_partkey").alias("palette_id"), F.element_at(names, (F.col("p_size") % 7 + 1).cast("int")).alias("name"))
    return palette_files.resolve_names(n, spark)


_SHEET = "sh AS (SELECT p_partkey AS asset_id, 1+p_size%3 AS rows, 1+p_size%4 AS cols, 5+p_partkey%4 AS frame_w, 6+p_partkey%3 AS frame_h, p_size%2 AS margin, p_size%3 AS spacing FROM part)"
SLICE = f"""{_SHEET}, sl AS (SELECT asset_id, r*cols+c AS frame_idx, 'frame_'||lpad((r*cols+c)::VARCHAR,3,'0') AS name, margin+c*(frame_w+spacing) AS x, margin+r*(frame_h+spacing) AS y, frame_w AS w, frame_h AS h, frame_w//2 AS pivot_x, frame_h AS pivot_y, 120::BIGINT AS duration_ms
  FROM sh, (SELECT range AS r FROM range(3)), (SELECT range AS c FROM range(4)) WHERE r<rows AND c<cols)"""


def sheets(spark, d):
    s, k = F.col("p_size").cast("long"), F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("asset_id"), (s % 3 + 1).alias("rows"), (s % 4 + 1).alias("cols"), (k % 4 + 5).alias("frame_w"),
                                          (k % 3 + 6).alias("frame_h"), (s % 2).alias("margin"), (s % 3).alias("spacing"))


def slices(spark, d):
    return G.slice_frames(sheets(spark, d))


@query("p13_frame_slice", f"WITH {SLICE} SELECT * FROM sl")
def p13(spark, d):
    return slices(spark, d)


@query("p15_source_rects", f"""WITH {SLICE}, z AS (SELECT sl.*, s, ph FROM sl JOIN (SELECT p_partkey AS asset_id, 2+p_size%4 AS s, p_size%2 AS ph FROM part) USING (asset_id)),
 q AS (SELECT *, greatest(0,least(63,ph+x*s)) AS sx, greatest(0,least(63,ph+y*s)) AS sy FROM z) SELECT asset_id, frame_idx, sx, sy, greatest(1,least(64-sx,w*s)) AS sw, greatest(1,least(64-sy,h*s)) AS sh FROM q""")
def p15(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), (F.col("p_size") % 4 + 2).cast("long").alias("s"), (F.col("p_size") % 2).cast("long").alias("ph"))
    side = F.lit(64).cast("long")
    return G.source_rects(slices(spark, d).join(part, "asset_id"), F.col("s"), F.col("ph"), side, side).select("asset_id", "frame_idx", "sx", "sy", "sw", "sh")


@query("p24_tile_repeat", f"WITH {SLICE} SELECT asset_id, frame_idx, r AS row, c AS col, c*w AS x, r*h AS y, w, h FROM sl, (SELECT range AS r FROM range(3)), (SELECT range AS c FROM range(3))")
def p24(spark, d):
    return G.tile_repeat(slices(spark, d), 3)


@query("p24_seam_guides", f"WITH {SLICE} SELECT asset_id, frame_idx, ax AS axis, CASE WHEN ax='x' THEN w*i ELSE h*i END AS position FROM sl, (SELECT unnest(['x','y']) AS ax), (SELECT range AS i FROM range(1,3))")
def p24g(spark, d):
    return G.seam_guides(slices(spark, d), 3)


@query("p25_sheet_fit", f"""WITH {_SHEET}, f AS (SELECT *, greatest(1,greatest(0,40-margin*2+spacing)//greatest(1,frame_w+spacing)) AS fc, greatest(1,greatest(0,24-margin*2+spacing)//greatest(1,frame_h+spacing)) AS fr,
  margin*2+cols*frame_w+greatest(0,cols-1)*spacing AS uw, margin*2+rows*frame_h+greatest(0,rows-1)*spacing AS uh FROM sh)
 SELECT asset_id, fr AS fit_rows, fc AS fit_cols, uw AS used_w, uh AS used_h, greatest(0,uw-24) AS over_x, greatest(0,uh-20) AS over_y, uw<=24 AND uh<=20 AS fits FROM f""")
def p25(spark, d):
    s = sheets(spark, d)
    n = lambda v: F.lit(v).cast("long")
    uw = G.used_size(F.col("cols"), F.col("frame_w"), F.col("margin"), F.col("spacing"))
    uh = G.used_size(F.col("rows"), F.col("frame_h"), F.col("margin"), F.col("spacing"))
    return s.select("asset_id", G.fit_count(n(24), F.col("frame_h"), F.col("margin"), F.col("spacing")).alias("fit_rows"),
                    G.fit_count(n(40), F.col("frame_w"), F.col("margin"), F.col("spacing")).alias("fit_cols"), uw.alias("used_w"), uh.alias("used_h"),
                    F.greatest(n(0), uw - 24).alias("over_x"), F.greatest(n(0), uh - 20).alias("over_y"), ((uw <= 24) & (uh <= 20)).alias("fits"))


@query("p22_rgba_bytes", "SELECT p_partkey AS asset_id, (1000+p_size*100)*(800+p_size*90)*4::BIGINT AS bytes, (1000+p_size*100)*(800+p_size*90)*4::BIGINT > 134217728 AS over_budget FROM part")
def p22(spark, d):
    s = F.col("p_size").cast("long")
    b = G.rgba_bytes(s * 100 + 1000, s * 90 + 800)
    return table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), b.alias("bytes"), (b > T.MEMORY_BUDGET).alias("over_budget"))


@query("p23_target_size", f"""WITH k AS (SELECT p_partkey AS asset_id, (100+p_size*7)::BIGINT AS sw, (60+p_partkey%90)::BIGINT AS sh, (16+p_size)::BIGINT AS v FROM part),
 b AS (SELECT asset_id, v*6 AS q, unnest([8,16,24,32,64,128,256,512])::BIGINT AS bud FROM k), n AS (SELECT asset_id, bud FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY abs(q-bud), bud) AS rn FROM b) WHERE rn=1)
 SELECT asset_id, v AS target_w, greatest(1,{rnd('v/(sw::DOUBLE/sh)')}) AS target_h, round(sw::DOUBLE/v,6) AS scale_x, bud AS budget FROM k JOIN n USING (asset_id)""")
def p23(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), (F.col("p_size").cast("long") * 7 + 100).alias("sw"), (F.col("p_partkey") % 90 + 60).alias("sh"),
                                       (F.col("p_size").cast("long") + 16).alias("v"))
    return p.select("asset_id", F.col("v").alias("target_w"), G.aspect_height(F.col("v"), F.col("sw"), F.col("sh")).alias("target_h"),
                    F.round(F.col("sw") / F.col("v"), 6).alias("scale_x"), G.nearest_budget(F.col("v") * 6).alias("budget"))


@query("p14_contained_rect", """WITH k AS (SELECT p_partkey AS asset_id, (20+p_size*9)::BIGINT AS w, (10+p_partkey%200)::BIGINT AS h FROM part), s AS (SELECT *, least(200::DOUBLE/w, 150::DOUBLE/h) AS raw FROM k),
 z AS (SELECT *, CASE WHEN raw>=1 THEN greatest(1e0,floor(raw)) ELSE raw END AS sc FROM s), q AS (SELECT *, greatest(1,floor(w*sc))::BIGINT AS dw, greatest(1,floor(h*sc))::BIGINT AS dh FROM z)
 SELECT asset_id, floor((200-dw)/2e0)::BIGINT AS draw_x, floor((150-dh)/2e0)::BIGINT AS draw_y, dw AS draw_w, dh AS draw_h FROM q""")
def p14(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), (F.col("p_size").cast("long") * 9 + 20).alias("w"), (F.col("p_partkey") % 200 + 10).alias("h"))
    rect = G.contained_rect(F.lit(200).cast("long"), F.lit(150).cast("long"), F.col("w"), F.col("h"))
    return p.select("asset_id", *[c.alias(n) for n, c in rect.items()])


@query("p19_uniform_boundaries", f"""WITH k AS (SELECT p_partkey AS asset_id, (p_size%3)::BIGINT AS st, (2+p_size%5)+0.25e0*(p_partkey%4) AS sc, (40+p_partkey%30)::BIGINT AS sz FROM part), n AS (SELECT *, greatest(1,floor((sz-st)/sc))::BIGINT AS cnt FROM k)
 SELECT asset_id, i AS line, greatest(0,least(sz,{rnd('st+i*sc')})) AS pos FROM n, range(80) t(i) WHERE i<=cnt""")
def p19(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), (F.col("p_size") % 3).cast("long").alias("st"),
                                       ((F.col("p_size") % 5 + 2) + F.lit(0.25) * (F.col("p_partkey") % 4)).alias("sc"), (F.col("p_partkey") % 30 + 40).alias("sz"))
    return p.select("asset_id", F.posexplode(G.uniform_boundaries(F.col("st"), F.col("sc"), F.col("sz"))).alias("line", "pos")).withColumn("line", F.col("line").cast("long"))


@query("p16_buckets_and_ratios", """SELECT doc_id, CASE WHEN n_chars*700<102400 THEN '0-100kb' WHEN n_chars*700<1048576 THEN '100kb-1mb' WHEN n_chars*700<5242880 THEN '1mb-5mb' WHEN n_chars*700<20971520 THEN '5mb-20mb' ELSE '20mb-plus' END AS bucket,
 CASE WHEN length(trim(source))=0 THEN 'unknown' ELSE lower(trim(source)) END AS source_key, greatest(0e0,least(1e0,round(n_chars/3777e0,4))) AS fill FROM documents""")
def p16(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", T.size_bucket(n * 700).alias("bucket"), T.normalise(F.col("source")).alias("source_key"), T.ratio(n / 3777.0).alias("fill"))


@query("p17_error_kinds", """WITH e AS (SELECT event_id, ['render','export','import','fix'][1+event_id%4] AS op, ['Cancelled by user','Access DENIED','Worker stale','decode PNG failed','bad image','oops'][1+user_id%6] AS msg FROM events)
 SELECT event_id, CASE WHEN contains(lower(msg),'cancel') THEN 'cancelled' WHEN contains(lower(msg),'permission') OR contains(lower(msg),'denied') OR contains(lower(msg),'not allowed') THEN 'permission_denied'
  WHEN contains(lower(msg),'worker') OR contains(lower(msg),'postmessage') OR contains(lower(msg),'stale') THEN 'worker_failed' WHEN op='render' THEN 'render_failed' WHEN op='export' THEN 'export_failed'
  WHEN op='import' AND (contains(lower(msg),'decode') OR contains(lower(msg),'image') OR contains(lower(msg),'png') OR contains(lower(msg),'jpeg') OR contains(lower(msg),'webp')) THEN 'decode_failed' ELSE 'unknown' END AS kind FROM e""")
def p17(spark, d):
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    msg = pick(("Cancelled by user", "Access DENIED", "Worker stale", "decode PNG failed", "bad image", "oops"), F.col("user_id") % 6)
    return table(spark, d, "events").select("event_id", T.error_kind(msg, pick(("render", "export", "import", "fix"), F.col("event_id") % 4)).alias("kind"))


def _redact(s: str) -> str:
    for pattern, to in T.REDACTIONS:
        flags = "gi" if pattern.startswith("(?i)") else "g"
        s = f"regexp_replace({s}, '{pattern.removeprefix('(?i)')}', '{to.replace('$1', chr(92) + '1')}', '{flags}')"
    return s


@query("p18_redact_documents", f"""WITH t AS (SELECT doc_id, text||' key API_KEY=abc'||doc_id||' Bearer tok.en.'||(doc_id*7919+10000000)||' sk-abcdefgh'||doc_id||', prompt draw it. end' AS s FROM documents), r AS (SELECT doc_id, s, {_redact('s')} AS o FROM t)
 SELECT doc_id, md5(o) AS digest, (length(o)-length(replace(o,'[REDACTED]','')))//10 AS redactions FROM r""")
def p18(spark, d):
    i = F.col("doc_id")
    s = F.concat(F.col("text"), F.lit(" key API_KEY=abc"), i, F.lit(" Bearer tok.en."), i * 7919 + 10000000, F.lit(" sk-abcdefgh"), i, F.lit(", prompt draw it. end"))
    r = table(spark, d, "documents").select("doc_id", T.redact(s).alias("o"))
    n = F.floor((F.length("o") - F.length(F.replace(F.col("o"), F.lit(T.REDACTED), F.lit("")))) / 10)
    return r.select("doc_id", F.md5("o").alias("digest"), n.alias("redactions"))


@query("p18_redact_maps", """SELECT event_id, CASE WHEN user_id%3=0 THEN '[REDACTED]' ELSE event_type END AS value FROM events""")
def p18m(spark, d):
    key = F.when(F.col("user_id") % 3 == 0, "x_Api-Key").otherwise("kind")
    e = table(spark, d, "events").select("event_id", key.alias("k"), T.redact_map(F.create_map(key, F.col("event_type"))).alias("m"))
    return e.select("event_id", F.col("m")[F.col("k")].alias("value"))


@query("p21_path_guard", r"""WITH p AS (SELECT page_id, CASE page_id%6 WHEN 0 THEN url WHEN 1 THEN 'out/'||page_id||'.json' WHEN 2 THEN '/abs/x' WHEN 3 THEN 'a/../b' WHEN 4 THEN 'C:\x' ELSE 'Walk Cycle #'||page_id END AS p FROM pages), n AS (SELECT page_id, p, replace(p, chr(92), '/') AS q FROM p)
 SELECT page_id, NOT (length(q)=0 OR starts_with(q,'/') OR regexp_matches(q,'^[a-zA-Z]:') OR len(list_filter(string_split(q,'/'), lambda s: s='..' OR s=''))>0) AS safe,
  regexp_replace(regexp_replace(lower(p),'[^a-z0-9_-]+','_','g'),'^_+|_+$','','g') AS file FROM n""")
def p21(spark, d):
    i = F.col("page_id")
    p = (F.when(i % 6 == 0, F.col("url")).when(i % 6 == 1, F.concat(F.lit("out/"), i, F.lit(".json"))).when(i % 6 == 2, F.lit("/abs/x")).when(i % 6 == 3, F.lit("a/../b"))
         .when(i % 6 == 4, F.lit("C:\\x")).otherwise(F.concat(F.lit("Walk Cycle #"), i)))
    return table(spark, d, "pages").select("page_id", T.safe_bundle_path(p).alias("safe"), T.safe_frame_file(p, i).alias("file"))
