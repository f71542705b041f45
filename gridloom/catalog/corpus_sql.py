"""DuckDB statements of the derived collections, used by the oracle queries."""

PX_PART = """px_part AS (
  SELECT asset_id, s, x, y, y*24+x AS idx, 24::BIGINT AS w, 24::BIGINT AS h,
    (hh*47+23)%256 + CASE WHEN (x*3+y*5+asset_id)%17=0 THEN 1 ELSE 0 END AS r,
    (hh*83+71)%256 AS g, (hh*131+113)%256 AS b,
    CASE WHEN cx=0 OR cy=0 OR cx=23//s OR cy=23//s OR hh=0 THEN 0 WHEN hh=1 THEN 128 ELSE 255 END::BIGINT AS a
  FROM (SELECT *, (asset_id*31+cx*7+cy*13+cx*cy)%11 AS hh FROM (
    SELECT asset_id, s, x, y, x//s AS cx, y//s AS cy FROM
      (SELECT p_partkey AS asset_id, (2+p_size%4)::BIGINT AS s FROM part),
      (SELECT range AS x FROM range(24)), (SELECT range AS y FROM range(24)))))"""

PX_VEC = """px_vec AS (
  SELECT asset_id, idx, idx%8 AS x, idx//8 AS y, 8::BIGINT AS w, 8::BIGINT AS h,
    v AS r, 255-v AS g, v//2 AS b, 255::BIGINT AS a
  FROM (SELECT asset_id, idx, least(255, floor(m - floor(m/256e0)*256e0))::BIGINT AS v
    FROM (SELECT vec_id AS asset_id, (generate_subscripts(embedding,1)-1)::BIGINT AS idx,
                 unnest(embedding)::DOUBLE*1000e0 AS m FROM embeddings)))"""

PX_TILE = """px_tile AS (
  SELECT asset_id, x, y, y*16+x AS idx, 16::BIGINT AS w, 16::BIGINT AS h,
    (k*29+(x%4)*11+(y%4)*17)%256 AS r, (k*53+(x%4)*7)%256 AS g, (k*97+(y%4)*13)%256 AS b, 255::BIGINT AS a
  FROM (SELECT doc_id AS asset_id, x, y, (doc_id*7+(x//4)*3+(y//4)*5)%(3+doc_id%6) AS k
    FROM documents, (SELECT range AS x FROM range(16)), (SELECT range AS y FROM range(16))))"""

PX_SHEET = """px_sheet AS (
  SELECT asset_id, x, y, y*96+x AS idx, 96::BIGINT AS w, 64::BIGINT AS h, CASE WHEN i THEN (hh*47+23)%256 ELSE 0 END AS r, CASE WHEN i THEN (hh*83+71)%256 ELSE 0 END AS g,
    CASE WHEN i THEN (hh*131+113)%256 ELSE 0 END AS b, (CASE WHEN i THEN 255 ELSE 0 END)::BIGINT AS a
  FROM (SELECT asset_id, x, y, (asset_id*31+c*7+rw*13)%11 AS hh, x>=2 AND c<3+(asset_id+rw)%2 AND x>=c*22+4+(asset_id*7+c*3+rw*5)%3 AND x<c*22+4+(asset_id*7+c*3+rw*5)%3+13+(asset_id+c)%4 AND y>=rw*30+5 AND y<rw*30+5+16+(asset_id+rw)%5 AS i
    FROM (SELECT s_suppkey AS asset_id, x, y, CASE WHEN y<32 THEN 0 ELSE 1 END AS rw, (x-2)//22 AS c FROM supplier, (SELECT range AS x FROM range(96)), (SELECT range AS y FROM range(64)))))"""

FRAMES = """frames AS (
  SELECT l_orderkey AS asset_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)-1 AS frame_idx,
    'f_'||l_linenumber AS name, 16+l_partkey%17 AS w, 16+l_suppkey%17 AS h,
    ((16+l_partkey%17)//2 + l_linenumber%3)::DOUBLE AS pivot_x,
    (16+l_suppkey%17 - l_linenumber%2)::DOUBLE AS pivot_y,
    60+10*CAST(l_quantity AS BIGINT) AS duration_ms, l_linenumber::BIGINT AS line
  FROM lineitem)"""

ANIMATIONS = """animations AS (
  SELECT o_orderkey AS asset_id, 'clip_'||lower(substring(o_orderpriority,3)) AS name,
    list_transform(range(1, 2+o_custkey%8), lambda i: 'f_'||i) AS frames, 4+o_custkey%12 AS fps,
    o_orderstatus<>'F' AS loop,
    CASE o_orderstatus WHEN 'O' THEN 'forward' WHEN 'F' THEN 'reverse' ELSE 'pingpong' END AS direction
  FROM orders)"""

PALETTES = """palettes AS (
  SELECT n_regionkey::BIGINT AS palette_id, (n_nationkey//5)::BIGINT AS pos,
    ((n_nationkey::BIGINT*47+23)%256)*65536+((n_nationkey::BIGINT*83+71)%256)*256+(n_nationkey::BIGINT*131+113)%256 AS color
  FROM nation)"""

JOB_EVENTS = """job_events AS (
  SELECT event_id, user_id AS job_id, ts,
    CASE WHEN event_type='signup' THEN 'queued' WHEN event_type IN ('click','view') THEN 'running'
         WHEN event_type='purchase' THEN 'completed' ELSE 'failed' END AS status, value/50e0 AS progress
  FROM events)"""


def linear(v: str) -> str:
    return f"(CASE WHEN ({v})/255e0 <= 0.04045e0 THEN ({v})/255e0/12.92e0 ELSE pow((({v})/255e0+0.055e0)/1.055e0, 2.4e0) END)"


def hex6(v: str) -> str:
    return f"('#'||printf('%06x', ({v})::BIGINT))"


def rnd(v: str) -> str:
    return f"CAST(floor(({v})+0.5e0) AS BIGINT)"
