"""Scalar colour columns over whole collections."""

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.corpus_sql import PX_PART, PX_VEC, hex6, linear, rnd
from gridloom.functions import color as C
from gridloom.sources import corpora

def rgba():
    return tuple(F.col(c) for c in "rgba")


@query("p01_pack_hex", f"""WITH {PX_VEC} SELECT asset_id, idx, r*65536+g*256+b AS packed, {hex6('r*65536+g*256+b')} AS hex,
  r AS red, g AS green, b AS blue FROM px_vec""")
def p01(spark, d):
    R, G, B, A = rgba()
    px = corpora.px_vec(spark, d).withColumn("packed", C.pack(R, G, B)).withColumn("hex", C.hex_of(F.col("packed")))
    r, g, b = C.rgb(C.from_hex(F.col("hex")))
    return px.select("asset_id", "idx", "packed", "hex", r.alias("red"), g.alias("green"), b.alias("blue"))


@query("p02_quantisers", f"""WITH {PX_PART}, k AS (SELECT asset_id, (r//8*8)*65536+(g//8*8)*256+(b//8*8) AS five,
    (r//8)*1024+(g//8)*32+(b//8) AS b15, (r//16)*256+(g//16)*16+(b//16) AS b12,
    (r//32)*512+(g//32)*64+(b//32)*8+(a//32) AS run FROM px_part)
  SELECT asset_id, count(DISTINCT five) AS five, count(DISTINCT b15) AS b15, count(DISTINCT b12) AS b12, count(DISTINCT run) AS run,
    CAST(sum(five+b15+b12+run) AS BIGINT) AS check_sum FROM k GROUP BY 1""")
def p02(spark, d):
    R, G, B, A = rgba()
    px = corpora.px_part(spark, d)
    k = px.select("asset_id", C.five_bit(C.pack(R, G, B)).alias("five"), C.bucket15(R, G, B).alias("b15"),
                  C.bucket12(R, G, B).alias("b12"), C.run_key(R, G, B, A).alias("run"))
    names = ["five", "b15", "b12", "run"]
    one = k.groupBy("asset_id", *names).agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("asset_id").agg(*[F.countDistinct(c).alias(c) for c in names],
                                       F.sum((F.col("five") + F.col("b15") + F.col("b12") + F.col("run")) * F.col("n")).alias("check_sum"))


_LAB = f"""lin AS (SELECT range AS v, {linear('range')} AS l FROM range(256)),
 lms AS (SELECT p.*, cbrt(0.4122214708e0*x.l+0.5363325363e0*y.l+0.0514459929e0*z.l) AS L_, cbrt(0.2119034982e0*x.l+0.6806995451e0*y.l+0.1073969566e0*z.l) AS M_,
   cbrt(0.0883024619e0*x.l+0.2817188376e0*y.l+0.6299787005e0*z.l) AS S_, x.l AS lr, y.l AS lg, z.l AS lb
   FROM px_vec p JOIN lin x ON x.v=p.r JOIN lin y ON y.v=p.g JOIN lin z ON z.v=p.b)"""


@query("p03_oklab", f"""WITH {PX_VEC}, {_LAB}
 SELECT asset_id, idx, round(0.2104542553e0*L_+0.793617785e0*M_-0.0040720468e0*S_,6)+0e0 AS lab_l,
  round(1.9779984951e0*L_-2.428592205e0*M_+0.4505937099e0*S_,6)+0e0 AS lab_a, round(0.0259040371e0*L_+0.7827717662e0*M_-0.808675766e0*S_,6)+0e0 AS lab_b,
  r*65536+g*256+b AS back FROM lms""")
def p03(spark, d):
    R, G, B, A = rgba()
    l, a, b = C.oklab(R, G, B)
    px = corpora.px_vec(spark, d).select("asset_id", "idx", l.alias("l"), a.alias("a"), b.alias("b"))
    return px.select("asset_id", "idx", *[(F.round(c, 6) + 0.0).alias(f"lab_{c}") for c in "lab"],
                     C.oklab_to_rgb(F.col("l"), F.col("a"), F.col("b")).alias("back"))


_PIV = "(CASE WHEN {t} > 216e0/24389e0 THEN cbrt({t}) ELSE (24389e0/27e0*({t})+16e0)/116e0 END)"


@query("p04_cielab", f"""WITH {PX_VEC}, {_LAB}, xyz AS (SELECT asset_id, idx, r, g, b,
   (0.4124564e0*lr+0.3575761e0*lg+0.1804375e0*lb)*100e0/95.047e0 AS tx, (0.2126729e0*lr+0.7151522e0*lg+0.072175e0*lb)*100e0/100e0 AS ty,
   (0.0193339e0*lr+0.119192e0*lg+0.9503041e0*lb)*100e0/108.883e0 AS tz FROM lms),
 f AS (SELECT *, {_PIV.format(t='tx')} AS fx, {_PIV.format(t='ty')} AS fy, {_PIV.format(t='tz')} AS fz FROM xyz)
 SELECT asset_id, idx, round(116e0*fy-16e0,6)+0e0 AS lab_l, round(500e0*(fx-fy),6)+0e0 AS lab_a, round(200e0*(fy-fz),6)+0e0 AS lab_b,
  r*65536+g*256+b AS back FROM f""")
def p04(spark, d):
    R, G, B, A = rgba()
    l, a, b = C.cielab(R, G, B)
    px = corpora.px_vec(spark, d).select("asset_id", "idx", l.alias("l"), a.alias("a"), b.alias("b"))
    return px.select("asset_id", "idx", *[(F.round(c, 6) + 0.0).alias(f"lab_{c}") for c in "lab"],
                     C.cielab_to_rgb(F.col("l"), F.col("a"), F.col("b")).alias("back"))


@query("p05_distances", f"""WITH {PX_VEC} SELECT asset_id, idx, (r-128)*(r-128)+(g-64)*(g-64)+(b-32)*(b-32) AS rgb_sq,
  abs(r-128)+abs(g-64)+abs(b-32)+abs(a-200) AS l1, greatest(abs(r-128),abs(g-64),abs(b-32)) AS max_delta FROM px_vec""")
def p05(spark, d):
    R, G, B, A = rgba()
    ref = tuple(F.lit(v).cast("long") for v in (128, 64, 32, 200))
    return corpora.px_vec(spark, d).select(
        "asset_id", "idx", C.distance_sq((R, G, B), ref[:3]).alias("rgb_sq"), C.l1((R, G, B, A), ref).alias("l1"),
        C.max_channel_delta((R, G, B), ref[:3]).alias("max_delta"))


_HUE = """(CASE WHEN mx=mn THEN 0e0 WHEN mx=r THEN (CASE WHEN g>=b THEN (g-b)/(mx-mn)::DOUBLE*60e0 ELSE (g-b)/(mx-mn)::DOUBLE*60e0+360e0 END)
  WHEN mx=g THEN ((b-r)/(mx-mn)::DOUBLE+2e0)*60e0 ELSE ((r-g)/(mx-mn)::DOUBLE+4e0)*60e0 END)"""


@query("p06_luma_saturation_hue", f"""WITH {PX_VEC}, m AS (SELECT *, greatest(r,g,b) AS mx, least(r,g,b) AS mn FROM px_vec)
 SELECT asset_id, idx, round(r*0.2126e0+g*0.7152e0+b*0.0722e0,6) AS luma709, round(r*0.299e0+g*0.587e0+b*0.114e0,6) AS luma601,
  round(CASE WHEN mx=0 THEN 0e0 ELSE (mx-mn)/mx::DOUBLE END,6) AS sat, mx-mn AS spread,
  least(5, floor({_HUE}/60e0))::BIGINT AS hue, abs(r-g)+abs(g-b)+abs(b-r) AS colorfulness FROM m""")
def p06(spark, d):
    R, G, B, A = rgba()
    return corpora.px_vec(spark, d).select(
        "asset_id", "idx", F.round(C.luma709(R, G, B), 6).alias("luma709"), F.round(C.luma601(R, G, B), 6).alias("luma601"),
        F.round(C.saturation(R, G, B), 6).alias("sat"), C.spread(R, G, B).alias("spread"),
        C.hue_sextant(R, G, B).alias("hue"), C.colorfulness(R, G, B).alias("colorfulness"))


def _family(r, g, b):
    mx, mn = f"greatest({r},{g},{b})", f"least({r},{g},{b})"
    cut = f"({mx}-greatest(24,{rnd(f'({mx}-{mn})*0.35e0')}))"
    return f"(CASE WHEN {mx}<48 OR {mx}-{mn}<32 THEN 0 ELSE (CASE WHEN {r}>={cut} THEN 1 ELSE 0 END)+(CASE WHEN {g}>={cut} THEN 2 ELSE 0 END)+(CASE WHEN {b}>={cut} THEN 4 ELSE 0 END) END)"


_KEYS = "r, g, b, greatest(r,g,b) AS mx, least(r,g,b) AS mn"


@query("p07_chroma_families", f"""WITH {PX_PART}, k AS (SELECT asset_id, {_KEYS}, {_family('r','g','b')} AS fam, {_family('71','23','200')} AS bgf FROM px_part),
 v AS (SELECT asset_id, fam,
   CASE WHEN fam<>0 THEN fam WHEN g>=24 AND g-r>=18 AND g-b>=18 THEN 2 WHEN r>=32 AND b>=24 AND least(r,b)-g>=18 THEN 5 ELSE 0 END AS mfam,
   (r+g+b>=620 AND mx-mn<=56) OR (mx<=72 AND mx-mn<=56) OR (mx<=128 AND mn>=24 AND r+g+b<=300 AND mx-mn<=96) AS prot,
   NOT (fam<>0 AND fam=bgf AND abs(r-71)+abs(g-23)+abs(b-200)<=64)
    AND NOT ((mx<56 OR mx-mn<38 OR abs(r-g)+abs(g-b)+abs(b-r)<72) AND (mx<150 OR mx-mn<88 OR abs(r-g)+abs(g-b)+abs(b-r)<160)) AND fam IN (2,5) AS matte FROM k)
 SELECT asset_id, fam::BIGINT AS family, mfam::BIGINT AS matte_family, prot AS protected, matte, count(*) AS n FROM v GROUP BY 1,2,3,4,5""")
def p07(spark, d):
    R, G, B, A = rgba()
    bg = tuple(F.lit(v).cast("long") for v in (71, 23, 200))
    return corpora.px_part(spark, d).groupBy(
        "asset_id", C.chroma_family(R, G, B).alias("family"), C.matte_family(R, G, B).alias("matte_family"),
        C.protected_silhouette(R, G, B).alias("protected"), C.presentation_matte(R, G, B, bg).alias("matte"),
    ).agg(F.count(F.lit(1)).alias("n"))
