"""Histograms, palettes and nearest-colour matching."""

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.corpus_sql import PX_PART, PX_TILE, PX_VEC, hex6, linear
from gridloom.functions import color as C
from gridloom.operators import histogram as H
from gridloom.operators import palette as P
from gridloom.operators.ordering import top_k
from gridloom.operators.stencil import transparent_boundary
from gridloom.sources import corpora


def hist_sql(src: str, name: str = "hist") -> str:
    return f"{name} AS (SELECT asset_id, r*65536+g*256+b AS color, count(*) AS n, min(idx) AS first_idx FROM {src} WHERE a>=16 GROUP BY 1,2)"


FIVE = "((color//65536)//8*8)*65536+((color//256%256)//8*8)*256+(color%256)//8*8"


def palette_sql(n: int, hist: str = "hist", name: str = "pal") -> str:
    return f"""{name} AS (SELECT asset_id, pos-1 AS pos, color, n FROM (
      SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, f) AS pos FROM (
        SELECT asset_id, color, sum(n)::BIGINT AS n, min(first_idx) AS f FROM (
          SELECT asset_id, n, first_idx, CASE WHEN count(*) OVER (PARTITION BY asset_id) <= {n} THEN color ELSE {FIVE} END AS color FROM {hist})
        GROUP BY 1,2)) WHERE pos <= {n})"""


def lab_sql(src: str, name: str) -> str:
    """OKLab coordinates of ``color`` in ``src`` through a 256-row linear table."""
    return f"""{name} AS (SELECT q.*, 0.2104542553e0*c1+0.793617785e0*c2-0.0040720468e0*c3 AS ll, 1.9779984951e0*c1-2.428592205e0*c2+0.4505937099e0*c3 AS la,
      0.0259040371e0*c1+0.7827717662e0*c2-0.808675766e0*c3 AS lb FROM (
      SELECT p.*, cbrt(0.4122214708e0*x.l+0.5363325363e0*y.l+0.0514459929e0*z.l) AS c1, cbrt(0.2119034982e0*x.l+0.6806995451e0*y.l+0.1073969566e0*z.l) AS c2,
        cbrt(0.0883024619e0*x.l+0.2817188376e0*y.l+0.6299787005e0*z.l) AS c3
      FROM {src} p JOIN lin x ON x.v=p.color//65536 JOIN lin y ON y.v=p.color//256%256 JOIN lin z ON z.v=p.color%256) q)"""


LIN = f"lin AS (SELECT range AS v, {linear('range')} AS l FROM range(256))"


def nearest_sql(colors: str, pal: str, name: str = "best") -> str:
    """Argmin per (asset, color); both inputs carry ll, la, lb."""
    return f"""{name} AS (SELECT asset_id, color, best FROM (SELECT c.asset_id, c.color, p.color AS best, row_number() OVER (PARTITION BY c.asset_id, c.color
      ORDER BY round((p.ll-c.ll)*(p.ll-c.ll)+(p.la-c.la)*(p.la-c.la)+(p.lb-c.lb)*(p.lb-c.lb), 9), p.pos) AS rn
      FROM {colors} c JOIN {pal} p USING (asset_id)) WHERE rn=1)"""


def part_hist(spark, d):
    return H.histogram(corpora.px_part(spark, d))


@query("j01_nearest_palette_usage", f"""WITH {PX_PART}, {hist_sql('px_part')}, {palette_sql(8)}, {LIN},
 b5 AS (SELECT asset_id, {FIVE} AS color, sum(n)::BIGINT AS n FROM hist GROUP BY 1,2), {lab_sql('b5','cl')}, {lab_sql('pal','pl')}, {nearest_sql('cl','pl')}
 SELECT asset_id, best AS color, sum(n)::BIGINT AS n FROM best JOIN b5 USING (asset_id, color) GROUP BY 1,2""")
def j01_usage(spark, d):
    px = corpora.px_part(spark, d)
    return P.bucket_usage(px, H.frequency_palette(H.histogram(px), 8))


@query("j01_remap_pixels", f"""WITH {PX_PART}, {hist_sql('px_part')}, {palette_sql(4)}, {LIN},
 b5 AS (SELECT DISTINCT asset_id, {FIVE} AS color FROM hist), {lab_sql('b5','cl')}, {lab_sql('pal','pl')}, {nearest_sql('cl','pl')},
 k AS (SELECT *, CASE WHEN a>=16 THEN (r//8*8)*65536+(g//8*8)*256+b//8*8 END AS color FROM px_part)
 SELECT k.asset_id, idx, CASE WHEN a>=16 THEN best ELSE r*65536+g*256+b END AS packed, a FROM k LEFT JOIN best USING (asset_id, color)""")
def j01_remap(spark, d):
    px = corpora.px_part(spark, d)
    out = P.remap(px, H.frequency_palette(H.histogram(px), 4))
    return out.select("asset_id", "idx", C.pack(F.col("r"), F.col("g"), F.col("b")).alias("packed"), "a")


@query("p12_ordered_dither", f"""WITH {PX_VEC}, {hist_sql('px_vec')}, {palette_sql(6)}, {LIN},
 sh AS (SELECT *, ([0,8,2,10,12,4,14,6,3,11,1,9,15,7,13,5][((y%4)*4+x%4+1)::INT]+0.5e0)/16e0*96e0-48e0 AS s FROM px_vec),
 k AS (SELECT asset_id, idx, greatest(0,least(255,floor(r+s+0.5e0)))::BIGINT*65536+greatest(0,least(255,floor(g+s+0.5e0)))::BIGINT*256+greatest(0,least(255,floor(b+s+0.5e0)))::BIGINT AS color FROM sh),
 dc AS (SELECT DISTINCT asset_id, color FROM k), {lab_sql('dc','cl')}, {lab_sql('pal','pl')}, {nearest_sql('cl','pl')}
 SELECT k.asset_id, idx, best AS packed FROM k JOIN best USING (asset_id, color)""")
def p12(spark, d):
    px = corpora.px_vec(spark, d)
    out = P.ordered_dither(px, H.frequency_palette(H.histogram(px), 6), 4)
    return out.select("asset_id", "idx", C.pack(F.col("r"), F.col("g"), F.col("b")).alias("packed"))


@query("a01_exact_histogram", f"WITH {PX_PART}, {hist_sql('px_part')} SELECT asset_id, color, n, first_idx FROM hist")
def a01(spark, d):
    return part_hist(spark, d)


@query("a02_distinct_colors", f"""WITH {PX_PART}, k AS (SELECT asset_id, a, r*65536+g*256+b AS color FROM px_part), e AS (SELECT asset_id, a, color, {FIVE} AS c5 FROM k)
 SELECT asset_id, count(DISTINCT color) FILTER (a>=16) AS exact_visible, count(DISTINCT color*256+a) AS exact_rgba,
  count(DISTINCT c5) AS bins_all, count(DISTINCT c5) FILTER (a>=16) AS bins_visible FROM e GROUP BY 1""")
def a02(spark, d):
    return H.distinct_colors(corpora.px_part(spark, d))


@query("a03_frequency_palette", f"WITH {PX_VEC}, {hist_sql('px_vec')}, {palette_sql(24)} SELECT asset_id, pos, {hex6('color')} AS color, n FROM pal")
def a03(spark, d):
    pal = H.frequency_palette(H.histogram(corpora.px_vec(spark, d)), 24)
    return pal.select("asset_id", "pos", C.hex_of(F.col("color")).alias("color"), "n")


_TOP = "r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, first_idx) AS rk, sum(n) OVER (PARTITION BY asset_id) AS total, count(*) OVER (PARTITION BY asset_id) AS exact_colors FROM hist)"


@query("a05_auto_color_count", f"""WITH {PX_VEC}, {hist_sql('px_vec')}, {_TOP},
 c AS (SELECT *, sum(n) OVER (PARTITION BY asset_id ORDER BY rk) AS run FROM r WHERE rk<=48)
 SELECT asset_id, exact_colors, CASE WHEN exact_colors<=48 THEN exact_colors ELSE coalesce(min(rk) FILTER (run::DOUBLE/total>=0.985e0), 48) END AS colors FROM c GROUP BY asset_id, exact_colors""")
def a05(spark, d):
    return H.auto_color_count(H.histogram(corpora.px_vec(spark, d)), cap=48)


@query("w06_cumulative_share", f"""WITH {PX_PART}, {hist_sql('px_part')}, {_TOP}
 SELECT asset_id, rk AS rank, color, n, run::BIGINT AS run, round(run::DOUBLE/total,6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY asset_id ORDER BY rk) AS run FROM r) WHERE rk<=64""")
def w06(spark, d):
    return H.cumulative_share(part_hist(spark, d)).withColumn("share", F.round("share", 6))


@query("a06_alpha_counts", f"WITH {PX_PART} SELECT asset_id, count(*) FILTER (a=0) AS transparent, count(*) FILTER (a>0 AND a<255) AS soft FROM px_part GROUP BY 1")
def a06(spark, d):
    return H.alpha_counts(corpora.px_part(spark, d))


@query("a40_palette_preview", f"""WITH {PX_VEC}, {hist_sql('px_vec')}, s AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY first_idx) AS seen FROM hist),
 st AS (SELECT asset_id, max(first_idx) FILTER (seen=41) AS stop, least(40, count(*)) AS total_colors FROM s GROUP BY 1),
 c AS (SELECT p.asset_id, r*65536+g*256+b AS color, count(*) AS n, min(idx) AS f FROM px_vec p JOIN st USING (asset_id) WHERE stop IS NULL OR idx<stop GROUP BY 1,2),
 t AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, f) AS rk FROM c)
 SELECT asset_id, string_agg({hex6('color')}, ' ' ORDER BY rk) AS colors, total_colors, stop IS NOT NULL AS truncated FROM t JOIN st USING (asset_id) WHERE rk<=8 GROUP BY asset_id, total_colors, stop""")
def a40(spark, d):
    return H.palette_preview(corpora.px_vec(spark, d), 8, 40)


_BND = """bnd AS (SELECT *, x=0 OR y=0 OR x=w-1 OR y=h-1 OR least(lag(a) OVER q, lead(a) OVER q, lag(a) OVER v, lead(a) OVER v) < 16 AS edge FROM {src}
  WINDOW q AS (PARTITION BY asset_id, y ORDER BY x), v AS (PARTITION BY asset_id, x ORDER BY y))"""


@query("a30_dominant_outline", f"""WITH {PX_TILE}, {_BND.format(src='px_tile')}, {hist_sql('px_tile')},
 e AS (SELECT asset_id, r*65536+g*256+b AS color, count(*) AS edges FROM bnd WHERE a>=16 AND edge AND r*299+g*587+b*114<=72000 AND greatest(r,g,b)<=96 GROUP BY 1,2),
 t AS (SELECT asset_id, sum(n) AS total FROM hist GROUP BY 1)
 SELECT asset_id, arg_max(color, edges*1e9+n*1e5-first_idx) AS outline FROM hist JOIN e USING (asset_id, color) JOIN t USING (asset_id)
 WHERE n>=greatest(4e0, total*0.02e0) AND edges/n::DOUBLE>=0.35e0 GROUP BY 1""")
def a30_outline(spark, d):
    px = corpora.px_tile(spark, d)
    return H.dominant_outline(transparent_boundary(px).filter("a >= 16"), H.histogram(px))


_SAT = "(CASE WHEN greatest(r,g,b)=0 THEN 0e0 ELSE (greatest(r,g,b)-least(r,g,b))/greatest(r,g,b)::DOUBLE END)"
_RGBH = "hr AS (SELECT *, color//65536 AS r, color//256%256 AS g, color%256 AS b, sum(n) OVER (PARTITION BY asset_id) AS total FROM hist)"


@query("a30_vivid_accents", f"""WITH {PX_PART}, {hist_sql('px_part')}, {_RGBH},
 v AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, first_idx) AS rank FROM hr WHERE {_SAT}>=0.62e0 AND n>=greatest(4e0,total*0.01e0))
 SELECT asset_id, rank, color, n FROM v WHERE rank<=2""")
def a30_vivid(spark, d):
    return H.vivid_accents(part_hist(spark, d))


_HUEB = """CASE WHEN mx=mn THEN 0e0 WHEN mx=r THEN (CASE WHEN g>=b THEN (g-b)/(mx-mn)::DOUBLE*60e0 ELSE (g-b)/(mx-mn)::DOUBLE*60e0+360e0 END)
  WHEN mx=g THEN ((b-r)/(mx-mn)::DOUBLE+2e0)*60e0 ELSE ((r-g)/(mx-mn)::DOUBLE+4e0)*60e0 END"""


@query("a30_salient_accents", f"""WITH {PX_VEC}, {hist_sql('px_vec')}, {_RGBH},
 m AS (SELECT *, {_SAT} AS sat, greatest(r,g,b) AS mx, least(r,g,b) AS mn FROM hr),
 k AS (SELECT *, least(5,floor(({_HUEB})/60e0)) AS hue, least(3,floor(sat*4e0)) AS sb, least(3,floor(mx/255e0*4e0)) AS vb FROM m WHERE sat>=0.33e0 AND mx/255e0>=0.2e0),
 p AS (SELECT *, row_number() OVER (PARTITION BY asset_id,hue,sb,vb ORDER BY sat DESC, n DESC, first_idx) AS rn, sum(n) OVER (PARTITION BY asset_id,hue,sb,vb) AS area FROM k),
 c AS (SELECT asset_id, hue, color, area::BIGINT AS area, sat*sqrt(area::DOUBLE) AS score FROM p WHERE rn=1 AND area>=greatest(8e0,total*0.001e0)),
 f AS (SELECT *, row_number() OVER (PARTITION BY asset_id, hue ORDER BY score DESC, area DESC, color) AS fam FROM c),
 o AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY CASE WHEN fam=1 THEN 0 ELSE 1 END, score DESC, area DESC, color) AS rank FROM f)
 SELECT asset_id, rank, color, area, round(score,6) AS score FROM o WHERE rank<=4""")
def a30_salient(spark, d):
    return H.salient_accents(H.histogram(corpora.px_vec(spark, d)), 4)


_RES = f"""{PX_PART}, {hist_sql('px_part')}, {palette_sql(6)},
 res AS (SELECT asset_id, color, pos FROM pal WHERE pos<2), ex AS (SELECT asset_id, {FIVE} AS color, min(pos) AS pos FROM pal GROUP BY 1,2)"""


def _reserved(spark, d):
    pal = H.frequency_palette(part_hist(spark, d), 6)
    ex = pal.groupBy("asset_id", C.five_bit(F.col("color")).alias("color")).agg(F.min("pos").alias("pos"))
    return pal.filter("pos < 2").select("asset_id", "color", "pos"), ex


@query("u01_reserved_union", f"""WITH {_RES}, u AS (SELECT asset_id, color, min(pos) AS k FROM (SELECT * FROM res UNION ALL SELECT asset_id, color, pos+100 FROM ex) GROUP BY 1,2)
 SELECT asset_id, pos-1 AS pos, color FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY k) AS pos FROM u) WHERE pos<=5""")
def u01(spark, d):
    res, ex = _reserved(spark, d)
    return P.merge_reserved(res, ex, 5)


@query("u02_extracted_minus_reserved", f"""WITH {_RES}, rb AS (SELECT asset_id, color FROM res UNION SELECT asset_id, {FIVE} FROM res)
 SELECT asset_id, color, pos FROM ex WHERE (asset_id, color) NOT IN (SELECT (asset_id, color) FROM rb)""".replace("(asset_id, color) NOT IN (SELECT (asset_id, color) FROM rb)", "NOT EXISTS (SELECT 1 FROM rb WHERE rb.asset_id=ex.asset_id AND rb.color=ex.color)"))
def u02(spark, d):
    res, ex = _reserved(spark, d)
    return P.minus_reserved(ex, res)


@query("u03_active_vs_frame_colors", f"""WITH {PX_PART}, {hist_sql('px_part')}, {palette_sql(8)},
 act AS (SELECT DISTINCT asset_id, {FIVE} AS c FROM pal), fh AS (SELECT DISTINCT asset_id, y//8 AS band, (r//8*8)*65536+(g//8*8)*256+b//8*8 AS c FROM px_part WHERE a>=16)
 SELECT fh.asset_id, band, count(act.c) AS shared, count(*)-count(act.c) AS outside FROM fh LEFT JOIN act ON act.asset_id=fh.asset_id AND act.c=fh.c GROUP BY 1,2""")
def u03(spark, d):
    px = corpora.px_part(spark, d)
    act = H.frequency_palette(H.histogram(px), 8).select("asset_id", C.five_bit(F.col("color")).alias("c")).distinct().withColumn("hit", F.lit(1))
    c5 = C.five_bit(C.pack(F.col("r"), F.col("g"), F.col("b")))
    bands = px.filter("a >= 16").select("asset_id", F.floor(F.col("y") / 8).alias("band"), c5.alias("c")).distinct()
    return bands.join(act.hint("merge"), ["asset_id", "c"], "left").groupBy("asset_id", "band").agg(
        F.count("hit").alias("shared"), F.count_if(F.col("hit").isNull()).alias("outside"))


@query("l02_palette_order", f"""WITH {PX_PART}, {hist_sql('px_part')}
 SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, first_idx) AS ord, {hex6('color')} AS color FROM hist""")
def l02(spark, d):
    from gridloom.operators.ordering import rank_in_chunks

    neg = part_hist(spark, d).withColumn("neg_n", -F.col("n"))
    return rank_in_chunks(neg, ["asset_id"], ["neg_n"], ["first_idx"], "ord").select("asset_id", "ord", C.hex_of(F.col("color")).alias("color"))
