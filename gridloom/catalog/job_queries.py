"""Jobs, telemetry, streams, signatures and reports."""

import uuid

from pyspark.sql import functions as F

from gridloom.catalog import query
from gridloom.catalog.corpus_sql import JOB_EVENTS, PX_PART, PX_TILE, PX_VEC, hex6
from gridloom.catalog.frame_queries import PROBLEMS, problems
from gridloom.catalog.grid_queries import PROFILE
from gridloom.functions import color as C
from gridloom.operators import grid as G
from gridloom.operators.ordering import top_k
from gridloom.plans import reports as R
from gridloom.sources import corpora
from gridloom.sources.tables import table
from gridloom.streaming import jobs as J
from gridloom.streaming import telemetry as T

JOBS = f"""{JOB_EVENTS}, je AS (SELECT *, ts::VARCHAR||lpad(event_id::VARCHAR,12,'0') AS k FROM job_events), en AS (SELECT job_id, min(k) AS e FROM je WHERE status IN ('completed','failed','cancelled') GROUP BY 1),
 lv AS (SELECT je.* FROM je LEFT JOIN en USING (job_id) WHERE e IS NULL OR k<=e),
 lj AS (SELECT job_id, arg_max(status,k) AS status, min(ts) FILTER (status='running') AS started, max(ts) AS last_ts, arg_max(progress,k) FILTER (status IN ('queued','running')) AS pr, count(*) AS events FROM lv GROUP BY 1),
 jobs AS (SELECT job_id, status, CASE WHEN status='completed' THEN 1e0 ELSE round(greatest(0e0,least(1e0,coalesce(pr,0e0))),6) END AS progress, coalesce(epoch_us(started),-1) AS started_us, coalesce(CASE WHEN status IN ('completed','failed','cancelled') THEN epoch_us(last_ts) END,-1) AS completed_us, events FROM lj)"""


def job_events(spark, d):
    return corpora.job_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("m02_job_state", f"WITH {JOBS} SELECT * FROM jobs")
def m02(spark, d):
    return J.latest_jobs(job_events(spark, d)).na.fill(-1, ["started_us", "completed_us"])


def _run_stream(spark, out, mode, reader):
    """Drain a stream into a table of the shared folder and read it back."""
    from gridloom.session import shared_folder

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/cp").option("path", f"{base}/data").trigger(availableNow=True).start()
    else:
        save = lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{base}/data")
        q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/cp").foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()
    return reader(spark.read.parquet(f"{base}/data"))


def _events_stream(spark, d):
    e = T.read_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    status = (F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type").isin("click", "view"), "running").when(F.col("event_type") == "purchase", "completed").otherwise("failed"))
    return e.select("event_id", F.col("user_id").alias("job_id"), "ts", status.alias("status"), (F.col("value") / 50.0).alias("progress"), "event_type", "user_id")


@query("m02_job_state_stream", f"WITH {JOBS} SELECT job_id, status, progress, started_us, completed_us FROM jobs")
def m02s(spark, d):
    out = J.latest_jobs_stream(_events_stream(spark, d))
    return _run_stream(spark, out, "update", lambda t: t.groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "started_us", "completed_us"), "epoch").alias("s")).select("job_id", "s.*")
                       .na.fill(-1, ["started_us", "completed_us"]))


@query("a36_job_status_counts", f"WITH {JOBS} SELECT count(*) FILTER (status='queued') AS queued, count(*) FILTER (status='running') AS running, count(*) FILTER (status='completed') AS completed, count(*) FILTER (status='failed') AS failed, count(*) FILTER (status='cancelled') AS cancelled, count(*) AS total FROM jobs")
def a36(spark, d):
    return J.status_counts(J.latest_jobs(job_events(spark, d)))


@query("m03_latest_only", "SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)=1 AS kept FROM events")
def m03(spark, d):
    return J.latest_only(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ("user_id", "event_type")).drop("ts")


@query("m03_latest_only_stream", "SELECT user_id, event_type, arg_max(event_id, ts::VARCHAR||lpad(event_id::VARCHAR,12,'0')) AS event_id, count(*) AS requests FROM events GROUP BY 1,2")
def m03s(spark, d):
    out = J.latest_only_stream(_events_stream(spark, d), ("user_id", "event_type"))
    return _run_stream(spark, out, "complete", lambda t: t.filter(F.col("epoch") == t.agg(F.max("epoch")).first()[0]).drop("epoch"))


@query("m04_progress", f"""WITH {JOBS}, p AS (SELECT *, least(100e0,greatest(0e0,progress*100e0)) AS raw FROM lv), q AS (SELECT *, CASE WHEN status='completed' THEN 100 WHEN raw<100 AND floor(raw+0.5e0)=100 THEN 99 ELSE floor(raw+0.5e0) END::BIGINT AS pc FROM p)
 SELECT job_id, event_id, status, max(pc) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS percent FROM q""")
def m04(spark, d):
    return J.progress_stream(job_events(spark, d))


@query("m05_result_reuse", """WITH rq AS (SELECT p_partkey AS asset_id, concat_ws('|',p_partkey,p_size||'x24',p_size*96,32) AS key FROM part), rs AS (SELECT p_partkey AS asset_id, concat_ws('|',p_partkey,(p_size+CASE WHEN p_partkey%3=1 THEN 1 ELSE 0 END)||'x24',p_size*96,32) AS key, 'r'||p_partkey AS report FROM part WHERE p_partkey%3<>0)
 SELECT rq.asset_id, rq.key, CASE WHEN e.report IS NOT NULL THEN 'exact' WHEN f.report IS NOT NULL THEN 'fallback' ELSE 'miss' END AS hit, coalesce(e.report,f.report,'') AS report FROM rq LEFT JOIN rs e ON e.asset_id=rq.asset_id AND e.key=rq.key LEFT JOIN (SELECT asset_id, min(report) AS report FROM rs GROUP BY 1) f ON f.asset_id=rq.asset_id""")
def m05(spark, d):
    req, res = _cache_inputs(spark, d)
    return J.reuse_results(req, res).na.fill("", ["report"])


def _cache_inputs(spark, d):
    p = table(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    key = lambda size: J.cache_key(k.cast("string"), F.concat(size.cast("string"), F.lit("x24")), (s * 96).cast("string"), F.lit("32"))
    req = p.select(k.alias("asset_id"), key(s).alias("key"))
    res = p.filter(k % 3 != 0).select(k.alias("asset_id"), key(s + F.when(k % 3 == 1, 1).otherwise(0)).alias("key"), F.concat(F.lit("r"), k.cast("string")).alias("report"))
    return req, res


@query("m05_work_to_do", "SELECT p_partkey AS asset_id, concat_ws('|',p_partkey,p_size||'x24',p_size*96,32) AS key FROM part WHERE p_partkey%3 IN (0,1)")
def m05w(spark, d):
    return J.work_to_do(*_cache_inputs(spark, d))


@query("m05_pruned_results", "SELECT p_partkey AS asset_id, 'r'||p_partkey AS report FROM part WHERE p_partkey%3<>0 AND p_size>10")
def m05p(spark, d):
    _, res = _cache_inputs(spark, d)
    return J.prune_results(res, table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("asset_id"))).drop("key")


@query("m06_changed_assets", """SELECT o_orderkey AS asset_id, (o_orderkey%2=0 OR o_custkey%3=0 OR o_orderkey%7=0) AND o_custkey%10<>0 AS dirty,
 CASE WHEN o_custkey%10=0 THEN '' ELSE array_to_string(list_filter([CASE WHEN o_orderkey%2=0 THEN 'settings' END, CASE WHEN o_custkey%3=0 THEN 'frames' END, CASE WHEN o_orderkey%7=0 THEN 'export' END], lambda v: v IS NOT NULL), ',') END AS reasons FROM orders""")
def m06(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"))
    snap = lambda tweak: [F.md5(F.concat("s", F.lit(r), F.when(tweak.get(r, F.lit(False)), "x").otherwise(""))).alias(r) for r in J.REASONS]
    edits = {"settings": F.col("asset_id") % 2 == 0, "frames": F.col("c") % 3 == 0, "export": F.col("asset_id") % 7 == 0}
    return J.changed_assets(o.select("asset_id", *snap(edits)), o.filter("c % 10 <> 0").select("asset_id", *snap({})))


@query("w10_phase_marks", "WITH f AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1,2), s AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY 1) SELECT user_id, event_type, epoch_us(ts)-epoch_us(t0) AS elapsed_us FROM f JOIN s USING (user_id)")
def w10(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return J.first_marks(e, ("user_id",), "event_type")


@query("w11_recent_marks", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank<=32")
def w11(spark, d):
    return top_k(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 32).drop("ts")


@query("a37_phase_timings", """SELECT event_type AS op, user_id%3 AS phase, count(*) AS n, min(value) AS min_ms, max(value) AS max_ms, round(avg(value),6) AS avg_ms, quantile_disc(value,0.5) AS median_ms, count(*) FILTER (value>=CASE WHEN user_id%3=0 THEN 32 ELSE 16 END) AS slow FROM events GROUP BY 1,2""")
def a37(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("op"), (F.col("user_id") % 3).alias("phase"), "value")
    return J.phase_summary(e, ("op", "phase"), "value", F.when(F.col("phase") == 0, 32).otherwise(16))


_INGEST = """SELECT event_id, user_id AS session_id, event_type AS event, coalesce(CASE WHEN json_type(props,'$.k') NOT IN ('OBJECT','ARRAY') THEN json_extract_string(props,'$.k') END,'') AS k, greatest(0,floor(value+0.5e0))::BIGINT AS duration_ms,
 CASE WHEN value*40000<102400 THEN '0-100kb' WHEN value*40000<1048576 THEN '100kb-1mb' WHEN value*40000<5242880 THEN '1mb-5mb' WHEN value*40000<20971520 THEN '5mb-20mb' ELSE '20mb-plus' END AS size_bucket FROM events WHERE user_id%4<>0"""


def _flat(df):
    return df.select("event_id", "session_id", "event", F.coalesce(F.col("props")["k"], F.lit("")).alias("k"), "duration_ms", "size_bucket")


@query("s15_telemetry_batch", _INGEST)
def s15(spark, d):
    e = corpora.telemetry(spark, d).withColumn("consent", F.col("session_id") % 4 != 0)
    return _flat(T.ingest(e, ("k",)))


@query("m01_telemetry_stream", _INGEST)
def m01(spark, d):
    e = T.read_events(spark, d).select("event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("event"), "value", "props")
    out = T.ingest_stream(e.withColumn("consent", F.col("session_id") % 4 != 0), ("k",))
    return _run_stream(spark, out, "append", _flat)


_SIGN = lambda src, name: f"""{name} AS (SELECT asset_id, max(w) AS width, max(h) AS height, count(*) FILTER (a>0) AS visible, count(*) FILTER (a=0) AS transparent, sum(((idx+1)*((r*65536+g*256+b)*256+a))%4294967291)::BIGINT AS checksum,
 max(CASE WHEN x=0 AND y=0 THEN concat_ws(',',r,g,b,a) END) AS p_0_0, max(CASE WHEN x=5 AND y=3 THEN concat_ws(',',r,g,b,a) END) AS p_5_3 FROM {src} GROUP BY 1),
 {name}p AS (SELECT asset_id, string_agg({hex6('c')}, ' ' ORDER BY c) AS palette FROM (SELECT DISTINCT asset_id, r*65536+g*256+b AS c FROM {src} WHERE a>0) GROUP BY 1)"""
_PTS = ((0, 0), (5, 3))


@query("a35_golden_signature", f"WITH {PX_PART}, {_SIGN('px_part','s')} SELECT s.*, palette FROM s LEFT JOIN sp USING (asset_id)")
def a35(spark, d):
    return R.golden_signature(corpora.px_part(spark, d), _PTS)


@query("a35_fnv_checksum", f"""WITH {PX_VEC}, rw AS (SELECT asset_id, y, list_reduce(list_prepend(2166136261::BIGINT, flatten(list([r,g,b,a] ORDER BY x))), lambda h, v: (xor(h,v)*16777619) & 4294967295) AS hv FROM px_vec GROUP BY 1,2)
 SELECT asset_id, list_reduce(list_prepend(2166136261::BIGINT, list(hv ORDER BY y)), lambda h, v: (xor(h,v)*16777619) & 4294967295) AS checksum FROM rw GROUP BY 1""")
def a35f(spark, d):
    return R.fnv_checksum(corpora.px_vec(spark, d))


@query("j06_golden_comparison", f"""WITH {PX_VEC}, alt AS (SELECT asset_id, idx, x, y, w, h, CASE WHEN asset_id%4=1 AND idx=7 THEN (r+1)%256 ELSE r END AS r, g, b, CASE WHEN asset_id%6=2 AND idx<3 THEN 0 ELSE a END AS a FROM px_vec WHERE asset_id%9<>0), {_SIGN('px_vec','e')}, {_SIGN('alt','c')},
 j AS (SELECT coalesce(e.asset_id,c.asset_id) AS asset_id, e.visible AS ev, c.visible AS cv, e.transparent AS et, c.transparent AS ct, e.checksum AS ek, c.checksum AS ck FROM e FULL JOIN c ON e.asset_id=c.asset_id)
 SELECT * FROM (SELECT asset_id, 'visible' AS field, ev::VARCHAR AS expected, cv::VARCHAR AS actual FROM j UNION ALL SELECT asset_id, 'transparent', et::VARCHAR, ct::VARCHAR FROM j UNION ALL SELECT asset_id, 'checksum', ek::VARCHAR, ck::VARCHAR FROM j) WHERE expected IS DISTINCT FROM actual""")
def j06(spark, d):
    px = corpora.px_vec(spark, d)
    alt = px.filter("asset_id % 9 <> 0").withColumn("r", F.when((F.col("asset_id") % 4 == 1) & (F.col("idx") == 7), (F.col("r") + 1) % 256).otherwise(F.col("r"))).withColumn(
        "a", F.when((F.col("asset_id") % 6 == 2) & (F.col("idx") < 3), 0).otherwise(F.col("a")))
    return R.compare_tables(R.golden_signature(px, _PTS), R.golden_signature(alt, _PTS), ["visible", "transparent", "checksum"])


@query("j07_budget_check", """WITH b AS (SELECT item_id AS benchmark, (20+item_id%9)::DOUBLE AS budget_ms, item_id%3=0 AS blocking FROM benchmark), r AS (SELECT user_id AS benchmark, round(avg(value),6) AS mean_ms FROM events GROUP BY 1),
 j AS (SELECT *, CASE WHEN mean_ms IS NULL THEN 'missing' WHEN mean_ms<=budget_ms THEN 'pass' ELSE 'warn' END AS status FROM b LEFT JOIN r USING (benchmark)) SELECT benchmark, blocking, status, round((mean_ms-budget_ms)/budget_ms*100e0,4) AS delta_pct, blocking AND status<>'pass' AS fails FROM j""")
def j07(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("benchmark"), (F.col("item_id") % 9 + 20).cast("double").alias("budget_ms"), (F.col("item_id") % 3 == 0).alias("blocking"))
    r = table(spark, d, "events").groupBy(F.col("user_id").alias("benchmark")).agg(F.round(F.avg("value"), 6).alias("mean_ms"))
    return R.check_budgets(b, r)


_SEV = "CASE code WHEN 'missing-frame' THEN 'warning' WHEN 'empty-palette' THEN 'info' ELSE 'error' END"


def _findings(spark, d):
    sev = F.when(F.col("code") == "missing-frame", "warning").when(F.col("code") == "empty-palette", "info").otherwise("error")
    return problems(spark, d).select("asset_id", sev.alias("severity"), F.when(F.col("code") != "frame-bounds", F.col("code")).alias("recommendation"),
                                     F.when(F.col("asset_id") % 5 == 0, "tilemap").otherwise("sprite").alias("asset_type"))


@query("a33_quality_rollup", f"""WITH {PROBLEMS}, f AS (SELECT {_SEV} AS sev, code FROM pb) SELECT (SELECT count(*) FROM orders) AS assets, count(*) AS findings, count(*) FILTER (code<>'frame-bounds') AS recommendations,
 CASE max(CASE sev WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) WHEN 3 THEN 'error' WHEN 2 THEN 'warning' WHEN 1 THEN 'info' ELSE 'none' END AS highest_severity FROM f""")
def a33(spark, d):
    return R.quality_rollup(_findings(spark, d), table(spark, d, "orders"))


@query("a33_severity_rollup", f"WITH {PROBLEMS}, f AS (SELECT CASE WHEN asset_id%5=0 THEN 'tilemap' ELSE 'sprite' END AS asset_type, {_SEV} AS severity FROM pb) SELECT coalesce(asset_type,'all') AS asset_type, coalesce(severity,'all') AS severity, count(*) AS n FROM f GROUP BY ROLLUP (asset_type, severity)")
def a33r(spark, d):
    return R.severity_cube(_findings(spark, d)).na.fill("all", ["asset_type", "severity"])


@query("w07_severity_ranking", f"""WITH {PROBLEMS}, g AS (SELECT asset_id, code, count(*) AS n FROM pb GROUP BY 1,2) SELECT asset_id, code, n, row_number() OVER (PARTITION BY asset_id ORDER BY CASE {_SEV} WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, code) AS rank FROM g""")
def w07(spark, d):
    g = problems(spark, d).groupBy("asset_id", "code").agg(F.count(F.lit(1)).alias("n"))
    order = F.when(F.col("code") == "missing-frame", 1).when(F.col("code") == "empty-palette", 2).otherwise(0)
    return top_k(g, ["asset_id"], [order, F.asc("code")], 13)


@query("l01_strongest_edges", f"WITH {PX_PART}, {PROFILE} SELECT asset_id, axis, pos, energy FROM profile ORDER BY energy DESC, asset_id, axis, pos LIMIT 50")
def l01(spark, d):
    return G.edge_profile(corpora.px_part(spark, d)).drop("size").orderBy(F.desc("energy"), "asset_id", "axis", "pos").limit(50)


_TYPES = ["Sprite", "sprite_sheet", " Animation-Sheet", "TILE", "Icon_Set", "ui", "background", "mystery", "portrait"]
_AV = ", ".join(f"('{a}','{t}','{m}',{c},'{dn}','{al}',{ns})" for a, t0 in R.TYPE_ALIASES.items() for t, m, c, dn, al, ns, _ in R.ASSET_TYPES if t == t0)
_PV = ", ".join(f"('{p}',{c},'{dn}','{al}',{ns})" for p, c, dn, al, ns in R.PROFILES)


@query("p20_settings_merge", f"""WITH a(alias,ty,mode,bc,bd,ba,bn) AS (VALUES {_AV}), pf(pid,pc,pd,pa,pn) AS (VALUES {_PV}),
 r AS (SELECT p_partkey AS asset_id, {_TYPES}[1+p_size%9] AS tn, ['balanced','cleanSprite','tilesetSafe','none'][1+p_partkey%4] AS pr, CASE WHEN p_size%5=0 THEN p_size END AS co, CASE WHEN p_partkey%6=0 THEN 'median' END AS ds FROM part)
 SELECT asset_id, coalesce(ty,'') AS asset_type, coalesce(mode,'') AS mode, coalesce(co,pc,bc,-1)::BIGINT AS max_colors, coalesce(ds,pd,bd,'') AS downscale, coalesce(pa,ba,'') AS alpha, coalesce(pn,bn,-1)::BIGINT AS denoise, ty IS NULL AS invalid_type
 FROM r LEFT JOIN a ON a.alias=lower(trim(replace(tn,'_',''))) LEFT JOIN pf ON pf.pid=pr""")
def p20(spark, d):
    pick = lambda v, i: F.element_at(F.array(*[F.lit(x) for x in v]), (i + 1).cast("int"))
    s, k = F.col("p_size"), F.col("p_partkey")
    r = table(spark, d, "part").select(k.alias("asset_id"), pick(_TYPES, s % 9).alias("type_name"), pick(["balanced", "cleanSprite", "tilesetSafe", "none"], k % 4).alias("profile"),
                                       F.when(s % 5 == 0, s.cast("long")).alias("colors"), F.when(k % 6 == 0, "median").alias("downscale"))
    return R.resolve_settings(r, spark).na.fill("", ["asset_type", "mode", "downscale", "alpha"]).na.fill(-1, ["max_colors", "denoise"])


@query("d08_palette_validation", """WITH p AS (SELECT p_partkey AS palette_id, CASE WHEN p_size%7=0 THEN ' ' ELSE p_name END AS name, CASE WHEN p_partkey%8=0 THEN [] ELSE ['#ABC','zz'||p_size,'#aabbcc','#'||lpad(p_size::VARCHAR,6,'0'), lpad(p_size::VARCHAR,6,'0')] END AS cs FROM part),
 u AS (SELECT palette_id, unnest(cs) AS c, generate_subscripts(cs,1)-1 AS i FROM p), t AS (SELECT *, regexp_replace(trim(c),'^#','') AS q FROM u), n AS (SELECT *, CASE WHEN regexp_matches(q,'^[0-9a-fA-F]{3}$') THEN '#'||lower(regexp_replace(q,'(.)','\\1\\1','g')) WHEN regexp_matches(q,'^[0-9a-fA-F]{6}$') THEN '#'||lower(q) END AS hx FROM t)
 SELECT palette_id, 'missing-name' AS code, '' AS detail, 'error' AS severity FROM p WHERE length(trim(name))=0 UNION ALL SELECT palette_id, 'invalid-color', i::VARCHAR, 'error' FROM n WHERE hx IS NULL
 UNION ALL SELECT palette_id, 'duplicate-color', hx, 'warning' FROM (SELECT *, row_number() OVER (PARTITION BY palette_id,hx ORDER BY i) AS rn FROM n WHERE hx IS NOT NULL) WHERE rn>1 UNION ALL SELECT palette_id, 'empty-palette', '', 'error' FROM p WHERE len(cs)=0""")
def d08(spark, d):
    s = F.col("p_size").cast("string")
    cs = F.array(F.lit("#ABC"), F.concat(F.lit("zz"), s), F.lit("#aabbcc"), F.concat(F.lit("#"), F.lpad(s, 6, "0")), F.lpad(s, 6, "0"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("palette_id"), F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_name")).alias("name"),
                                       F.when(F.col("p_partkey") % 8 == 0, F.array().cast("array<string>")).otherwise(cs).alias("colors"))
    return R.validate_palettes(p)


_KN = "[" + ",".join(f"'{c}'" for c in R.FAILURE_CATEGORIES) + "]"


@query("d09_fixture_validation", f"""WITH f AS (SELECT p_partkey AS id, CASE WHEN p_size%5=0 THEN p_name ELSE replace(p_name,' ','-') END AS slug, CASE WHEN p_size%9=0 THEN ' ' ELSE 'a.png' END AS src, CASE WHEN p_size%4=0 THEN [] WHEN p_size%4=1 THEN ['morphology-artifact','odd'] ELSE ['bright-matte-halo'] END AS cat,
  ['needs-review','done'][1+p_partkey%2] AS rev, ['single','spriteSheet','tileSheet'][1+p_partkey%3] AS mode, p_size%2=0 AS hs, p_size%3=0 AS hl, p_partkey%5 AS pv, p_size%6 AS pn FROM part)
, u AS (
 SELECT id, 'slug-format' AS code, NULL::VARCHAR AS value FROM f WHERE NOT regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$')
 UNION ALL SELECT id, 'no-source', NULL FROM f WHERE trim(src)='' UNION ALL SELECT id, 'no-category', NULL FROM f WHERE len(cat)=0
 UNION ALL SELECT id, 'review-not-listed', rev FROM f WHERE rev='done' UNION ALL SELECT id, 'no-size', NULL FROM f WHERE mode='single' AND NOT hs
 UNION ALL SELECT id, 'no-layout', NULL FROM f WHERE mode<>'single' AND NOT hl UNION ALL SELECT id, 'public-but-private-license', NULL FROM f WHERE pv=0
 UNION ALL SELECT id, 'privacy-notes-empty', NULL FROM f WHERE pn=0 UNION ALL SELECT id, 'license-notes-empty', NULL FROM f WHERE pn=1
 UNION ALL SELECT id, 'category-not-listed', c FROM (SELECT id, unnest(cat) AS c FROM f) WHERE NOT list_contains({_KN}, c))
 SELECT id AS fixture_id, code, value FROM u""")
def d09(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    lit = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    r = table(spark, d, "part").select(
        k.alias("fixture_id"), F.when(s % 5 == 0, F.col("p_name")).otherwise(F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).alias("slug"), F.when(s % 9 == 0, " ").otherwise("a.png").alias("source"),
        F.when(s % 4 == 0, lit()).when(s % 4 == 1, lit("morphology-artifact", "odd")).otherwise(lit("bright-matte-halo")).alias("categories"),
        F.when(k % 2 == 0, "needs-review").otherwise("done").alias("review"), F.when(k % 3 == 0, "single").when(k % 3 == 1, "spriteSheet").otherwise("tileSheet").alias("mode"),
        (s % 2 == 0).alias("has_size"), (s % 3 == 0).alias("has_layout"), F.when(k % 5 == 0, "safe-to-commit").otherwise("internal-reference-only").alias("privacy"),
        F.when(s % 6 == 0, "").otherwise("n").alias("privacy_notes"), F.lit("private-do-not-commit").alias("license"), F.when(s % 6 == 1, " ").otherwise("n").alias("license_notes"))
    return R.validate_fixtures(r)


_HV = ", ".join(f"('{c}','{step}')" for step, codes in R.NEXT_STEPS.items() for c in codes)


@query("d11_run_reports", f"""WITH h(code,step) AS (VALUES {_HV}), r AS (SELECT event_id AS run_id, CASE WHEN event_type='purchase' THEN 'success' ELSE 'failure' END AS status, ['invalid_options','decode_failed','unsafe_output','cancelled','odd'][1+user_id%5] AS code, user_id%6 AS exit_code, 'call failed TOKEN=abc'||event_id||' at step' AS m FROM events)
 SELECT run_id, 1::BIGINT AS schema_version, status, exit_code, replace(m,'abc'||run_id,'[REDACTED]') AS message, CASE WHEN status='success' THEN 'none' ELSE coalesce(step,'see-diagnostics') END AS next_step FROM r LEFT JOIN h USING (code)""")
def d11(spark, d):
    codes = F.array(*[F.lit(c) for c in ("invalid_options", "decode_failed", "unsafe_output", "cancelled", "odd")])
    e = table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "purchase", "success").otherwise("failure").alias("status"),
                                         F.element_at(codes, (F.col("user_id") % 5 + 1).cast("int")).alias("code"), (F.col("user_id") % 6).alias("exit_code"),
                                         F.concat(F.lit("call failed TOKEN=abc"), F.col("event_id").cast("string"), F.lit(" at step")).alias("message"))
    return R.run_reports(e, spark)


@query("u07_palette_edits", """WITH p AS (SELECT p_partkey AS id, unnest([0,1,2,3])::BIGINT AS pos, p_size AS s FROM part), c AS (SELECT *, 'c'||pos AS color, id%5 AS op FROM p),
 e AS (SELECT id, CASE WHEN op=0 AND pos>=1 THEN pos+1 WHEN op=2 AND pos>1 THEN pos-1 WHEN op=3 THEN CASE WHEN pos=0 THEN 2 WHEN pos<=2 THEN pos-1 ELSE pos END ELSE pos END AS pos, CASE WHEN op=1 AND pos=1 THEN 'new' ELSE color END AS color FROM c WHERE NOT (op=2 AND pos=1))
 SELECT id AS palette_id, pos, color FROM e UNION ALL SELECT p_partkey, 1, 'new' FROM part WHERE p_partkey%5=0""")
def u07(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("palette_id"))
    pal = part.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("color", F.concat(F.lit("c"), F.col("pos").cast("string")))
    op = F.col("palette_id") % 5
    n = lambda v: F.lit(v).cast("long")
    edits = part.filter(op < 4).select("palette_id", F.when(op == 0, "add").when(op == 1, "update").when(op == 2, "remove").otherwise("reorder").alias("op"),
                                       F.when(op == 3, n(0)).otherwise(n(1)).alias("at"), n(2).alias("to"), F.lit("new").alias("color"))
    return R.edit_palettes(pal, edits)
