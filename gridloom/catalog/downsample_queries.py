"""Block downsampling on the known grid of the part collection."""

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.corpus_sql import PX_PART, rnd
from gridloom.operators import downsample as D
from gridloom.sources import corpora

CL = "cl AS (SELECT *, x//s AS cx, y//s AS cy FROM px_part WHERE x//s < 24//s AND y//s < 24//s)"
DOM = f"""bk AS (SELECT asset_id, cx, cy, (r//8)*1024+(g//8)*32+b//8 AS bucket, count(*) AS n, max(idx) AS last, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb FROM cl WHERE a>=16 GROUP BY 1,2,3,4),
 win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id,cx,cy ORDER BY n DESC, last) AS rn FROM bk) WHERE rn=1),
 tot AS (SELECT asset_id, cx, cy, count(*) AS total, count(*) FILTER (a>=16) AS visible, sum(a) AS sa, sum(r) AS tr, sum(g) AS tg, sum(b) AS tb, count(*) FILTER (a<16) AS tn,
   sum(r) FILTER (a<16) AS ur, sum(g) FILTER (a<16) AS ug, sum(b) FILTER (a<16) AS ub FROM cl GROUP BY 1,2,3),
 dom AS (SELECT asset_id, cx, cy, {', '.join(rnd(f"CASE WHEN n IS NOT NULL THEN s{c}::DOUBLE/n ELSE u{c}::DOUBLE/tn END") + f" AS {c}" for c in 'rgb')}, {rnd('sa::DOUBLE/total')} AS a,
   coalesce(n::DOUBLE/total,0e0) AS coverage, visible::DOUBLE/total AS visible_coverage FROM tot LEFT JOIN win USING (asset_id,cx,cy))"""
MED = f"""md AS (SELECT asset_id, cx, cy, {', '.join(rnd(f"coalesce(quantile_cont({c},0.5) FILTER (a>=16), quantile_cont({c},0.5))") + f" AS {c}" for c in 'rgb')},
   {rnd('quantile_cont(a,0.5)')} AS a FROM cl GROUP BY 1,2,3)"""


def cells(spark, d):
    return D.to_cells(corpora.px_part(spark, d, with_scale=True), F.col("s"))


def colors(spark, d):
    return D.cell_colors(cells(spark, d))


@query("a10_downsample_dominant", f"WITH {PX_PART}, {CL}, {DOM} SELECT asset_id, cx, cy, r, g, b, a, round(coverage,6) AS coverage, round(visible_coverage,6) AS visible_coverage FROM dom")
def a10(spark, d):
    out = D.dominant(colors(spark, d))
    return out.withColumn("coverage", F.round("coverage", 6)).withColumn("visible_coverage", F.round("visible_coverage", 6))


@query("a11_downsample_median", f"WITH {PX_PART}, {CL}, {MED} SELECT asset_id, cx, cy, r, g, b, a FROM md")
def a11(spark, d):
    return D.median(colors(spark, d))


@query("a12_downsample_adaptive", f"""WITH {PX_PART}, {CL}, {DOM}, {MED}
 SELECT asset_id, cx, cy, {', '.join(f'CASE WHEN coverage>=0.6e0 THEN dom.{c} ELSE md.{c} END AS {c}' for c in 'rgba')} FROM dom JOIN md USING (asset_id, cx, cy)""")
def a12(spark, d):
    return D.adaptive(colors(spark, d))


@query("a13_downsample_average", f"""WITH {PX_PART}, {CL} SELECT asset_id, cx, cy,
 {', '.join(rnd(f"coalesce(sum({c}) FILTER (a>=16)::DOUBLE/count(*) FILTER (a>=16), sum({c})::DOUBLE/count(*))") + f" AS {c}" for c in 'rgb')}, {rnd('sum(a)::DOUBLE/count(*)')} AS a FROM cl GROUP BY 1,2,3""")
def a13(spark, d):
    return D.average(colors(spark, d))


@query("a14_downsample_nearest", f"WITH {PX_PART}, {CL} SELECT asset_id, cx, cy, r, g, b, a FROM cl WHERE x=cx*s AND y=cy*s")
def a14n(spark, d):
    return D.nearest(cells(spark, d))


@query("a14_downsample_bilinear", f"""WITH {PX_PART}, {CL}, wt AS (SELECT *, greatest(0e0,1e0-abs(x-cx*s-(s-1)/2e0))*greatest(0e0,1e0-abs(y-cy*s-(s-1)/2e0)) AS k FROM cl)
 SELECT asset_id, cx, cy, {', '.join(rnd(f"CASE WHEN sum(CASE WHEN a>=16 THEN k ELSE 0e0 END)>0 THEN sum(CASE WHEN a>=16 THEN k*{c} ELSE 0e0 END)/sum(CASE WHEN a>=16 THEN k ELSE 0e0 END) ELSE sum(k*{c}) END") + f" AS {c}" for c in 'rgb')},
 {rnd('sum(k*a)')} AS a FROM wt WHERE k>0 GROUP BY 1,2,3""")
def a14b(spark, d):
    return D.bilinear(cells(spark, d))


def _feature(bucket: str, score: str, cond: str) -> str:
    l = lambda p: f"({p}r*0.299e0+{p}g*0.587e0+{p}b*0.114e0)"
    return f"""WITH {PX_PART}, {CL}, tot AS (SELECT asset_id, cx, cy, count(*) AS total, count(*) FILTER (a>=16) AS vis, sum(a) AS sa FROM cl GROUP BY 1,2,3),
 bk AS (SELECT asset_id, cx, cy, s, {bucket} AS bucket, count(*) AS n, min(idx) AS fi, max(idx) AS la, sum(r)::DOUBLE AS sr, sum(g)::DOUBLE AS sg, sum(b)::DOUBLE AS sb,
   max(x)-min(x)+1 AS sx, max(y)-min(y)+1 AS sy FROM cl WHERE a>=16 GROUP BY 1,2,3,4,5),
 dm AS (SELECT asset_id, cx, cy, bucket AS db, n AS dn, sr/n AS dr, sg/n AS dg, sb/n AS dbl FROM (SELECT *, row_number() OVER (PARTITION BY asset_id,cx,cy ORDER BY n DESC, la) AS rn FROM bk) WHERE rn=1),
 j AS (SELECT bk.*, vis, db, dr, dg, dbl AS db_, sr/n AS o_r, sg/n AS o_g, sb/n AS o_b FROM bk JOIN dm USING (asset_id,cx,cy) JOIN tot USING (asset_id,cx,cy)),
 k AS (SELECT *, o_r*0.299e0+o_g*0.587e0+o_b*0.114e0 AS lo, dr*0.299e0+dg*0.587e0+db_*0.114e0 AS ld, n::DOUBLE/vis AS cov FROM j WHERE bucket<>db),
 sc AS (SELECT *, {score} AS score FROM k WHERE {cond}),
 pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id,cx,cy ORDER BY round(score,9) DESC, fi) AS rn FROM sc WHERE round(score,9)>0) WHERE rn=1)
 SELECT tot.asset_id, tot.cx, tot.cy, {', '.join(f"coalesce({rnd(f'pk.s{c}/pk.n')}, {rnd(dc)}, 0) AS {c}" for c, dc in (('r','dr_'),('g','dg_'),('b','db__')))}, {rnd('sa::DOUBLE/total')} AS a
 FROM tot LEFT JOIN pk USING (asset_id,cx,cy) LEFT JOIN (SELECT asset_id, cx, cy, dr AS dr_, dg AS dg_, dbl AS db__ FROM dm) q USING (asset_id,cx,cy)"""


_D_LINE = "(sx>=s*0.65e0 OR sy>=s*0.65e0)"
_D_CH = "sqrt((dr-o_r)*(dr-o_r)+(dg-o_g)*(dg-o_g)+(db_-o_b)*(db_-o_b))"


@query("a15_downsample_detail", _feature(
    "(r//8*8)*65536+(g//8*8)*256+b//8*8",
    f"(abs(lo-ld)+{_D_CH}*0.4e0)*(CASE WHEN {_D_LINE} THEN 1.25e0 ELSE 1e0 END)*least(1e0,cov/0.25e0)",
    f"(n>=greatest(2,ceil(vis*0.12e0)) OR ({_D_LINE} AND n>=greatest(2,ceil(s*0.65e0)))) AND (abs(lo-ld)>=36 OR {_D_CH}>=52)"))
def a15(spark, d):
    return D.detail_preserving(colors(spark, d))


_C_LINE = "(sx>=s*0.45e0 OR sy>=s*0.45e0)"
_C_CH = "(abs((o_r-lo)-(dr-ld))+abs((o_b-lo)-(db_-ld)))"


@query("a16_downsample_contrast", _feature(
    "(r//64)*16+(g//64)*4+b//64",
    f"(abs(lo-ld)*1.45e0+{_C_CH}*0.35e0)*(CASE WHEN {_C_LINE} AND cov<=0.2e0 THEN 1.65e0 ELSE 1e0 END)*(CASE WHEN lo<ld-48 THEN 1.35e0 ELSE 1e0 END)*greatest(0.4e0,least(1e0,cov/0.18e0))",
    f"(n>=greatest(2,ceil(vis*0.05e0)) OR ({_C_LINE} AND n>=greatest(2,ceil(s*0.45e0)))) AND (abs(lo-ld)>=48 OR {_C_CH}>=42)"))
def a16(spark, d):
    # a 5-pixel grid on art of another scale mixes colours inside cells
    return D.contrast(colors(spark, d))


@query("a16_contrast_off_grid", _feature(
    "(r//64)*16+(g//64)*4+b//64",
    f"(abs(lo-ld)*1.45e0+{_C_CH}*0.35e0)*(CASE WHEN {_C_LINE} AND cov<=0.2e0 THEN 1.65e0 ELSE 1e0 END)*(CASE WHEN lo<ld-48 THEN 1.35e0 ELSE 1e0 END)*greatest(0.4e0,least(1e0,cov/0.18e0))",
    f"(n>=greatest(2,ceil(vis*0.05e0)) OR ({_C_LINE} AND n>=greatest(2,ceil(s*0.45e0)))) AND (abs(lo-ld)>=48 OR {_C_CH}>=42)").replace(CL, "cl AS (SELECT * EXCLUDE (s), 6::BIGINT AS s, x//6 AS cx, y//6 AS cy FROM px_part)"))
def a16_off(spark, d):
    return D.contrast(D.cell_colors(D.to_cells(corpora.px_part(spark, d), F.lit(6).cast("long"))))


@query("a15_detail_off_grid", _feature(
    "(r//8*8)*65536+(g//8*8)*256+b//8*8",
    f"(abs(lo-ld)+{_D_CH}*0.4e0)*(CASE WHEN {_D_LINE} THEN 1.25e0 ELSE 1e0 END)*least(1e0,cov/0.25e0)",
    f"(n>=greatest(2,ceil(vis*0.12e0)) OR ({_D_LINE} AND n>=greatest(2,ceil(s*0.65e0)))) AND (abs(lo-ld)>=36 OR {_D_CH}>=52)").replace(CL, "cl AS (SELECT * EXCLUDE (s), 6::BIGINT AS s, x//6 AS cx, y//6 AS cy FROM px_part)"))
def a15_off(spark, d):
    return D.detail_preserving(D.cell_colors(D.to_cells(corpora.px_part(spark, d), F.lit(6).cast("long"))))


@query("a27_block_purity", f"""WITH {PX_PART}, {CL}, k AS (SELECT asset_id, cx, cy, (r//16)*256+(g//16)*16+b//16 AS bucket, count(*) AS n FROM cl WHERE a>=16 GROUP BY 1,2,3,4),
 c AS (SELECT asset_id, cx, cy, max(n)::DOUBLE/sum(n) AS share FROM k GROUP BY 1,2,3) SELECT asset_id, round(avg(share),6) AS purity, count(*) AS cells FROM c GROUP BY 1""")
def a27(spark, d):
    return D.block_purity(colors(spark, d))


@query("x04_regularise_mixels", f"""WITH {PX_PART}, cl AS (SELECT * EXCLUDE (s), 6::BIGINT AS s, (x+5)//6 AS cx, (y+5)//6 AS cy FROM px_part), {DOM},
 m AS (SELECT asset_id, cx, cy, count(*) FILTER (a>=16) AS opn, count(*) FILTER (a<16) AS trn, avg(r::DOUBLE) FILTER (a>=16) AS mr, avg(g::DOUBLE) FILTER (a>=16) AS mg, avg(b::DOUBLE) FILTER (a>=16) AS mb FROM cl GROUP BY 1,2,3),
 dv AS (SELECT asset_id, cx, cy, opn, trn, sum(abs(r-mr)+abs(g-mg)+abs(b-mb)) FILTER (a>=16) AS dev FROM cl JOIN m USING (asset_id,cx,cy) GROUP BY 1,2,3,4,5),
 st AS (SELECT asset_id, cx, cy, CASE WHEN opn=0 THEN false WHEN trn>0 THEN true ELSE round(dev/(opn*3),9)>24 END AS structured FROM dv)
 SELECT cl.asset_id, idx, {', '.join(f"(CASE WHEN structured THEN cl.{c} WHEN cl.a=0 THEN 0 ELSE dom.{c} END)::BIGINT AS {c}" for c in 'rgb')}, cl.a, structured FROM cl JOIN st USING (asset_id,cx,cy) JOIN dom USING (asset_id,cx,cy)""")
def x04(spark, d):
    px = corpora.px_part(spark, d)
    return D.regularise_mixels(D.to_cells(px, F.lit(6).cast("long"), 1, 1, partial=True))
