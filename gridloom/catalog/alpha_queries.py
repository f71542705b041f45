"""Alpha modes, border models and bounds."""

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.corpus_sql import PX_PART, PX_TILE, PX_VEC, rnd
from gridloom.functions import color as C
from gridloom.operators import alpha as A
from gridloom.operators import histogram as H
from gridloom.sources import corpora
from gridloom.sources.tables import table

_COLS = ["asset_id", "idx", "r", "g", "b", "a"]


@query("p08_visibility_filter", f"WITH {PX_PART} SELECT asset_id, count(*) FILTER (a>=16) AS visible16, count(*) FILTER (a>8) AS visible8, count(*) FILTER (a=0) AS transparent, count(*) FILTER (a BETWEEN 1 AND 254) AS soft FROM px_part GROUP BY 1")
def p08(spark, d):
    a = F.col("a")
    return corpora.px_part(spark, d).groupBy("asset_id").agg(
        F.count_if(a >= 16).alias("visible16"), F.count_if(a > 8).alias("visible8"), F.count_if(a == 0).alias("transparent"),
        F.count_if(a.between(1, 254)).alias("soft"))


@query("p09_binary_alpha", f"WITH {PX_PART} SELECT asset_id, idx, r, g, b, (CASE WHEN a>=128 THEN 255 ELSE 0 END)::BIGINT AS a FROM px_part")
def p09(spark, d):
    return A.binary_alpha(corpora.px_part(spark, d)).select(*_COLS)


@query("p10_color_key", f"""WITH {PX_PART} SELECT asset_id, idx, r, g, b,
 (CASE WHEN (r-70)*(r-70)+(g-154)*(g-154)+(b-244)*(b-244)<=972 THEN 0 WHEN a>=128 THEN 255 ELSE 0 END)::BIGINT AS a FROM px_part""")
def p10(spark, d):
    return A.color_key(corpora.px_part(spark, d), (70 << 16) | (154 << 8) | 244).select(*_COLS)


@query("p11_decontaminate", f"""WITH {PX_PART} SELECT asset_id, count(*) FILTER ((a=0 OR a<200) AND (r<>0 OR g<>0 OR b<>0)) AS changed,
 sum(CASE WHEN a=0 OR a<200 THEN 0 ELSE r+g+b END)::BIGINT AS rgb_sum FROM px_part GROUP BY 1""")
def p11(spark, d):
    out = A.decontaminate(corpora.px_part(spark, d), 0, 200)
    return out.groupBy("asset_id").agg(F.count_if("changed").alias("changed"), F.sum(F.col("r") + F.col("g") + F.col("b")).alias("rgb_sum"))


@query("p26_alpha_mode_dispatch", f"""WITH {PX_PART}, s AS (SELECT asset_id, idx, r, g, b, a, asset_id%3 AS m FROM px_part)
 SELECT asset_id, CASE m WHEN 0 THEN 'preserve' WHEN 1 THEN 'binary' ELSE 'colorKey' END AS mode,
  count(*) FILTER (na=0) AS transparent, count(*) FILTER (na>0 AND na<255) AS soft FROM (
  SELECT *, CASE WHEN m=0 THEN a WHEN m=2 AND (r-70)*(r-70)+(g-154)*(g-154)+(b-244)*(b-244)<=972 THEN 0 WHEN a>=128 THEN 255 ELSE 0 END AS na FROM s) GROUP BY 1,2""")
def p26(spark, d):
    m = F.col("p_partkey") % 3
    st = table(spark, d, "part").select(
        F.col("p_partkey").alias("asset_id"), F.when(m == 0, "preserve").when(m == 1, "binary").otherwise("colorKey").alias("mode"),
        F.lit((70 << 16) | (154 << 8) | 244).cast("long").alias("key"))
    out = A.alpha_mode(corpora.px_part(spark, d), st)
    return out.groupBy("asset_id", "mode").agg(F.count_if(F.col("a") == 0).alias("transparent"),
                                               F.count_if((F.col("a") > 0) & (F.col("a") < 255)).alias("soft"))


def corner_sql(src: str, size: int | str, name: str = "cm") -> str:
    t = f"((x<{size})::INT+(x>=w-{size})::INT)*((y<{size})::INT+(y>=h-{size})::INT)"
    return f"{name} AS (SELECT asset_id, " + ", ".join(f"sum({c}*{t})::DOUBLE/sum({t}) AS bg_{c}" for c in "rgba") + f" FROM {src} GROUP BY 1)"


@query("a07_corner_background", f"""WITH {PX_PART}, {corner_sql('px_part',12,'c12')}, {corner_sql('px_part',8,'c8')}, {corner_sql('px_part',1,'c1')}
 SELECT asset_id, {', '.join(f'round(c12.bg_{c},6) AS c12_{c}, round(c8.bg_{c},6) AS c8_{c}, round(c1.bg_{c},6) AS c1_{c}' for c in 'rgba')} FROM c12 JOIN c8 USING (asset_id) JOIN c1 USING (asset_id)""")
def a07(spark, d):
    px = corpora.px_part(spark, d)
    out = None
    for tag, size in (("c12", A.corner_size(12)), ("c8", A.corner_size(8)), ("c1", A.sheet_corner_size())):
        m = A.corner_mean(px, size).select("asset_id", *[F.round(f"bg_{c}", 6).alias(f"{tag}_{c}") for c in "rgba"])
        out = m if out is None else out.join(m, "asset_id")
    return out


def border_sql(src: str, step: int, twice: bool) -> str:
    top, side = "(y=0 OR y=h-1)", "(x=0 OR x=w-1)"
    second = f"({side} AND y%{step}=0)" if twice else f"({side} AND NOT {top} AND y%{step}=0)"
    return f"bp AS (SELECT * FROM (SELECT *, ({top} AND x%{step}=0)::INT + {second}::INT AS t, (r//16)*256+(g//16)*16+b//16 AS bucket FROM {src}) WHERE t>0)"


_TOP2 = """tp AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, bucket) AS rk FROM
  (SELECT asset_id, bucket, sum(t)::BIGINT AS n, sum(r*t) AS sr, sum(g*t) AS sg, sum(b*t) AS sb FROM bp GROUP BY 1,2))"""


def model_sql(src: str) -> str:
    q = lambda k, c: f"max({rnd(f's{c}::DOUBLE/n')}) FILTER (rk={k}) AS {c}{k}"
    return f"""{border_sql(src,1,True)}, {_TOP2}, two AS (SELECT asset_id, max(n) FILTER (rk=1) AS n1, max(n) FILTER (rk=2) AS n2, {q(1,'r')},{q(1,'g')},{q(1,'b')},{q(2,'r')},{q(2,'g')},{q(2,'b')} FROM tp GROUP BY 1)
 SELECT asset_id, r1*65536+g1*256+b1 AS first, CASE WHEN n2 IS NOT NULL AND n2>=n1*0.2e0 AND r1+g1+b1>540 AND r2+g2+b2>540 AND greatest(r1,g1,b1)-least(r1,g1,b1)<=24
  AND greatest(r2,g2,b2)-least(r2,g2,b2)<=24 AND abs(r1+g1+b1-r2-g2-b2)<=180 THEN r2*65536+g2*256+b2 ELSE -1 END AS second, n1, coalesce(n2,0) AS n2 FROM two"""


@query("a08_border_model", f"WITH {PX_PART}, " + model_sql("px_part"))
def a08(spark, d):
    return A.border_model(corpora.px_part(spark, d)).withColumn("second", F.coalesce("second", F.lit(-1)))


def bounds_sql(src: str, size: int) -> str:
    return f"""{corner_sql(src, size)}, bd AS (SELECT asset_id, w, h, CASE WHEN a>8 AND abs(r-bg_r)+abs(g-bg_g)+abs(b-bg_b)+abs(a-bg_a)>24 THEN x END AS fx,
   CASE WHEN a>8 AND abs(r-bg_r)+abs(g-bg_g)+abs(b-bg_b)+abs(a-bg_a)>24 THEN y END AS fy FROM {src} JOIN cm USING (asset_id)),
 bounds AS (SELECT asset_id, coalesce(min(fx),0) AS bx0, coalesce(min(fy),0) AS by0, coalesce(max(fx)-min(fx)+1, max(w)) AS bw, coalesce(max(fy)-min(fy)+1, max(h)) AS bh FROM bd GROUP BY 1)"""


@query("a09_sprite_bounds", f"WITH {PX_PART}, {bounds_sql('px_part', 12)} SELECT * FROM bounds")
def a09(spark, d):
    return A.sprite_bounds(corpora.px_part(spark, d))


@query("a20_baked_checker", f"""WITH {PX_TILE}, {border_sql('px_tile',1,False)}, {_TOP2}, tot AS (SELECT asset_id, sum(t) AS samples FROM bp GROUP BY 1),
 two AS (SELECT asset_id, coalesce(max(n) FILTER (rk=1),0) AS n1, coalesce(max(n) FILTER (rk=2),0) AS n2, coalesce(max(bucket) FILTER (rk=1),0) AS k1, coalesce(max(bucket) FILTER (rk=2),0) AS k2 FROM tp GROUP BY 1),
 c AS (SELECT *, k1//256*16+8 AS r1, k1//16%16*16+8 AS g1, k1%16*16+8 AS b1, k2//256*16+8 AS r2, k2//16%16*16+8 AS g2, k2%16*16+8 AS b2, (n1+n2)::DOUBLE/samples AS cov FROM two JOIN tot USING (asset_id))
 SELECT asset_id, greatest(r1,g1,b1)-least(r1,g1,b1)<=24 AND greatest(r2,g2,b2)-least(r2,g2,b2)<=24 AND r1+g1+b1>540 AND r2+g2+b2>540 AND cov>=0.72e0 AND n2::DOUBLE/n1>=0.2e0
  AND abs(r1+g1+b1-r2-g2-b2) BETWEEN 40 AND 220 AS detected, round(cov,6) AS coverage FROM c""")
def a20(spark, d):
    return A.baked_checker(corpora.px_tile(spark, d))
