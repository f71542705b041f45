"""Tilesets and tilemaps on the document collection (known tile classes)."""

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.corpus_sql import PX_TILE, hex6, rnd
from gridloom.operators import tiles as T
from gridloom.sources import corpora

_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list(v ORDER BY pos)), lambda h, p: (xor(h, p) * 16777619) & 4294967295)"
_V = "(r//16 + (g//16)*16 + (b//16)*256 + CASE WHEN a>=16 THEN 4096 ELSE 0 END)"


def _sig(size: str, src: str = "px_tile") -> str:
    return f"""sig AS (SELECT asset_id, size, row, col, {_FNV} AS signature FROM (SELECT asset_id, {size} AS size, y//{size} AS row, x//{size} AS col, (y%{size})*{size}+x%{size} AS pos, {_V} AS v FROM {src}) GROUP BY 1,2,3,4)"""


@query("a24_tile_signature", f"WITH {PX_TILE}, {_sig('4::BIGINT')} SELECT asset_id, row, col, signature FROM sig")
def a24(spark, d):
    return T.tile_signatures(corpora.px_tile(spark, d), F.lit(4).cast("long")).select("asset_id", "row", "col", "signature")


@query("a23_tile_size_candidates", f"""WITH {PX_TILE}, sz AS (SELECT unnest([2,3,4,8])::BIGINT AS size), e AS (SELECT * FROM px_tile, sz),
 sig AS (SELECT asset_id, size, row, col, {_FNV} AS signature FROM (SELECT asset_id, size, y//size AS row, x//size AS col, (y%size)*size+x%size AS pos, {_V} AS v FROM e WHERE y//size<16//size AND x//size<16//size) GROUP BY 1,2,3,4),
 t AS (SELECT asset_id, size, count(*) AS tiles, count(DISTINCT signature) AS unique_tiles FROM sig GROUP BY 1,2),
 c AS (SELECT *, 16//size AS rows, round(1e0-unique_tiles::DOUBLE/tiles,6) AS repeat_ratio, round((1e0-(2*(16%size)::DOUBLE/size)/2e0)*0.3e0+(1e0-unique_tiles::DOUBLE/tiles)*0.5e0+
   ((2*least(1e0,(16//size)::DOUBLE/4)+CASE WHEN (16//size)*(16//size)>=16 THEN 1e0 ELSE (16//size)*(16//size)/16e0 END)/3e0)*0.2e0,6) AS confidence FROM t)
 SELECT asset_id, rank, size, rows, rows AS cols, tiles, unique_tiles, repeat_ratio, confidence FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY floor(confidence/0.02e0) DESC, size DESC) AS rank FROM c)""")
def a23(spark, d):
    return T.tile_size_candidates(corpora.px_tile(spark, d), (2, 3, 4, 8))


PAIRS = """pr AS (SELECT a.asset_id, 'right-left' AS edge, a.y//4 AS row, a.x//4 AS col, a.y%4 AS pos, a.idx AS i1, b.idx AS i2, a.r AS r1, a.g AS g1, a.b AS b1, b.r AS r2, b.g AS g2, b.b AS b2
   FROM {src} a JOIN {src} b ON a.asset_id=b.asset_id AND a.y=b.y AND b.x=a.x+1 WHERE a.x%4=3
 UNION ALL SELECT a.asset_id, 'bottom-top', a.y//4, a.x//4, a.x%4, a.idx, b.idx, a.r, a.g, a.b, b.r, b.g, b.b FROM {src} a JOIN {src} b ON a.asset_id=b.asset_id AND a.x=b.x AND b.y=a.y+1 WHERE a.y%4=3)"""
STATS = """st AS (SELECT asset_id, edge, row, col, round(avg(sqrt(((r1-r2)*(r1-r2)+(g1-g2)*(g1-g2)+(b1-b2)*(b1-b2))::DOUBLE)/441.67295593e0),9) AS edge_delta,
  round(abs(avg(r1*0.2126e0+g1*0.7152e0+b1*0.0722e0)-avg(r2*0.2126e0+g2*0.7152e0+b2*0.0722e0))/255e0,9) AS light_delta FROM pr GROUP BY 1,2,3,4)"""


def issues_sql(cut: str) -> str:
    return f"""iss AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY CASE WHEN edge='right-left' THEN 0 ELSE 1 END, row, col, o) AS pos FROM (
   SELECT asset_id, edge, row, col, 0 AS o, 'edge-mismatch' AS code, edge_delta AS score FROM st WHERE edge_delta>={cut} UNION ALL
   SELECT asset_id, edge, row, col, 1, 'lighting-discontinuity', light_delta FROM st WHERE light_delta>=0.14e0))) """


@query("j05_adjacent_edge_pairs", f"WITH {PX_TILE}, {PAIRS.format(src='px_tile')} SELECT asset_id, edge, row, col, pos, r1*65536+g1*256+b1 AS left_color, r2*65536+g2*256+b2 AS right_color FROM pr")
def j05(spark, d):
    pack = lambda s: F.col(f"{s}.r") * 65536 + F.col(f"{s}.g") * 256 + F.col(f"{s}.b")
    return T.edge_pairs(corpora.px_tile(spark, d), 4).select("asset_id", "edge", "row", "col", "pos", pack("p").alias("left_color"), pack("q").alias("right_color"))


@query("a25_seam_statistics", f"WITH {PX_TILE}, {PAIRS.format(src='px_tile')}, {STATS} SELECT asset_id, edge, row, col, round(edge_delta,6) AS edge_delta, round(light_delta,6) AS light_delta FROM st")
def a25(spark, d):
    s = T.seam_stats(T.edge_pairs(corpora.px_tile(spark, d), 4))
    return s.withColumn("edge_delta", F.round("edge_delta", 6)).withColumn("light_delta", F.round("light_delta", 6))


@query("a25_seam_summary", f"WITH {PX_TILE}, {PAIRS.format(src='px_tile')}, {STATS} SELECT asset_id, count(*) AS seams, round(avg(edge_delta),6) AS avg_delta, round(max(edge_delta),6) AS max_delta, round(max(light_delta),6) AS max_light FROM st GROUP BY 1")
def a25s(spark, d):
    return T.seam_summary(T.seam_stats(T.edge_pairs(corpora.px_tile(spark, d), 4)))


_STRAT = "CASE WHEN code='lighting-discontinuity' THEN 'lightingHarmonization' WHEN score>=0.6e0 THEN 'manualRepaint' ELSE 'edgeColorHarmonization' END"


@query("h09_seam_issues", f"""WITH {PX_TILE}, {PAIRS.format(src='px_tile')}, {STATS}, {issues_sql('0.18e0')}
 SELECT asset_id, edge, row, col, pos, code, round(score,6) AS score, CASE WHEN score>=0.6e0 THEN 'error' ELSE 'warning' END AS severity, {_STRAT} AS strategy FROM iss""")
def h09(spark, d):
    return T.seam_issues(T.seam_stats(T.edge_pairs(corpora.px_tile(spark, d), 4)))


def _pass(src: str, edge: str, out: str) -> str:
    m = lambda c: rnd(f"({c}1+{c}2)/2e0")
    p = PAIRS.format(src=src).replace("pr AS", f"pr_{out} AS")
    return f"""{p}, fx_{out} AS (SELECT asset_id, unnest([i1,i2]) AS idx, {m('r')} AS nr, {m('g')} AS ng, {m('b')} AS nb FROM pr_{out} SEMI JOIN todo USING (asset_id,edge,row,col) WHERE edge='{edge}'),
 {out} AS (SELECT p.asset_id, p.x, p.y, p.idx, coalesce(nr,r) AS r, coalesce(ng,g) AS g, coalesce(nb,b) AS b FROM {src} p LEFT JOIN fx_{out} f ON f.asset_id=p.asset_id AND f.idx=p.idx)"""


@query("h10_seam_repair", f"""WITH {PX_TILE}, {PAIRS.format(src='px_tile')}, {STATS}, {issues_sql('0.08e0')}, todo AS (SELECT DISTINCT asset_id, edge, row, col FROM iss WHERE round(score,6)<0.6e0),
 {_pass('px_tile','right-left','v1')}, {_pass('v1','bottom-top','v2')} SELECT asset_id, idx, r, g, b FROM v2""")
def h10(spark, d):
    return T.repair_seams(corpora.px_tile(spark, d), 4).select("asset_id", "idx", "r", "g", "b")


CELLS = f"""tl AS (SELECT asset_id, y//4 AS row, x//4 AS col, string_agg((r*16777216+g*65536+b*256+a)::VARCHAR, ',' ORDER BY (y%4)*4+x%4) AS k, {rnd('avg(r::DOUBLE)')} AS mr, {rnd('avg(g::DOUBLE)')} AS mg, {rnd('avg(b::DOUBLE)')} AS mb FROM px_tile GROUP BY 1,2,3),
 fst AS (SELECT asset_id, k, min(row*1000+col) AS f, count(*) AS n FROM tl GROUP BY 1,2), ids AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY f)-1 AS tile_id FROM fst),
 cells AS (SELECT asset_id, row, col, tile_id, n, f//1000 AS first_row, f%1000 AS first_col, {hex6('mr*65536+mg*256+mb')} AS avg_color FROM tl JOIN ids USING (asset_id,k))"""


@query("h07_tilemap_cells", f"WITH {PX_TILE}, {CELLS} SELECT * FROM cells")
def h07(spark, d):
    return T.tile_cells(corpora.px_tile(spark, d), 4).drop("w", "h")


@query("h07_tilemap_summary", f"""WITH {PX_TILE}, {CELLS}, t AS (SELECT asset_id, count(*) AS tiles, max(tile_id)+1 AS unique_tiles FROM cells GROUP BY 1), u AS (SELECT *, 1e0-unique_tiles::DOUBLE/tiles AS rp FROM t)
 SELECT asset_id, tiles, unique_tiles, round(rp,6) AS repeat_ratio, round(0.35e0+rp*0.45e0+least(1e0,tiles/16e0)*0.2e0,6) AS confidence, CASE WHEN rp<0.25e0 THEN 'tilemap-low-repeat-confidence' ELSE '' END AS warnings,
 CASE WHEN rp<0.25e0 THEN 'inspectOnly' ELSE 'ready' END AS status FROM u""")
def h07s(spark, d):
    return T.tilemap_summary(T.tile_cells(corpora.px_tile(spark, d), 4), 4)


@query("s12_tilemap_rows", f"WITH {PX_TILE}, {CELLS} SELECT asset_id, row, '['||string_agg(tile_id::VARCHAR, ',' ORDER BY col)||']' AS ids FROM cells GROUP BY 1,2")
def s12(spark, d):
    return T.tilemap_rows(T.tile_cells(corpora.px_tile(spark, d), 4))


@query("h08_tilemap_validation", f"""WITH {PX_TILE}, {CELLS}, tiles AS (SELECT DISTINCT asset_id, tile_id FROM cells WHERE NOT (asset_id%5=0 AND tile_id=1)), mt AS (SELECT asset_id, 4+CASE WHEN asset_id%7=0 THEN 1 ELSE 0 END AS cols, 4+CASE WHEN asset_id%11=0 THEN 1 ELSE 0 END AS rows, max(tile_id)+1 AS u FROM cells GROUP BY 1)
 SELECT DISTINCT asset_id, 'missing tile id '||tile_id AS problem FROM cells ANTI JOIN tiles USING (asset_id,tile_id) UNION ALL
 SELECT asset_id, 'row '||row||' width mismatch' FROM (SELECT asset_id, row, count(*) AS n FROM cells GROUP BY 1,2) JOIN mt USING (asset_id) WHERE n<>cols UNION ALL
 SELECT asset_id, 'row count mismatch' FROM (SELECT asset_id, count(DISTINCT row) AS n FROM cells GROUP BY 1) JOIN mt USING (asset_id) WHERE n<>rows UNION ALL
 SELECT asset_id, 'unique tile count mismatch' FROM (SELECT asset_id, count(*) AS n FROM tiles GROUP BY 1) JOIN mt USING (asset_id) WHERE n<>u""")
def h08(spark, d):
    cells = T.tile_cells(corpora.px_tile(spark, d), 4)
    tiles = cells.select("asset_id", "tile_id").distinct().filter(~((F.col("asset_id") % 5 == 0) & (F.col("tile_id") == 1)))
    bump = lambda m: F.when(F.col("asset_id") % m == 0, 5).otherwise(4)
    meta = cells.groupBy("asset_id").agg((F.max("tile_id") + 1).alias("unique_tiles")).withColumn("cols", bump(7)).withColumn("rows", bump(11))
    return T.validate_tilemap(cells, tiles, meta)
