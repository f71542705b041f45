"""Registered queries of the package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe_tree, decontamination, filter_audit, html_extract, language_id, line_dedup, packing, partenum, quality_classifier, quality_rules, simple8b, source_divergence, toxicity
from gridloom.llm.tokens import public_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=3, held=1)


@query
def op3_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(_table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), end_id=2)


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(_table(spark, sf_dir, "documents")).select(*quality_rules.CONTRACT)


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=4, held=2)


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), end_id=1, capacity=4096)


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = line_dedup.dedup(_table(spark, sf_dir, "documents"), min_docs=10, by_id=True)
    return kept.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_table(spark, sf_dir, "documents"), folds=4, held=2)


ORACLES["op9_line_dedup"] = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""



@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar_classes(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


ORACLES["op6_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), threshold=0.8)


# Every window that shares a shingle with an item, compared in full.
ORACLES["op7_benchmark_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark),
d AS (SELECT doc_id, i - 1 AS pos, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM dw WHERE len(ws) >= 5)),
b AS (SELECT item_id, i - 1 AS pos, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM iw WHERE len(ws) >= 5)),
m AS (SELECT item_id, count(*) AS m FROM b GROUP BY item_id),
bc AS (SELECT item_id, g, count(*) AS n FROM b GROUP BY ALL),
top AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
c AS (SELECT DISTINCT d.doc_id, b.item_id, greatest(least(unnest(generate_series(d.pos - m.m + 1, d.pos)), top.n - m.m), 0) AS at FROM d JOIN b ON d.g = b.g JOIN m ON m.item_id = b.item_id JOIN top ON top.doc_id = d.doc_id),
w AS (SELECT c.doc_id, c.item_id, c.at, d.g, count(*) AS n FROM c JOIN m ON m.item_id = c.item_id JOIN d ON d.doc_id = c.doc_id AND d.pos >= c.at AND d.pos < c.at + m.m GROUP BY ALL),
s AS (SELECT w.doc_id, w.item_id, w.at, sum(w.n) AS a, sum(least(w.n, coalesce(bc.n, 0))) AS both FROM w LEFT JOIN bc ON bc.item_id = w.item_id AND bc.g = w.g GROUP BY ALL),
r AS (SELECT s.doc_id, s.item_id, m.m AS n_shingles, s.at AS start, CAST(s.both AS DOUBLE) / CAST(s.a + m.m - s.both AS DOUBLE) AS similarity FROM s JOIN m ON m.item_id = s.item_id)
SELECT doc_id, item_id, n_shingles, CAST(start AS BIGINT) AS start, similarity FROM r WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.round_trip(_table(spark, sf_dir, "documents"), public_path("byte_bpe_multi_50k.tiktoken"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergences(_table(spark, sf_dir, "documents"), min_docs=30, best=50)


ORACLES["op13_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY ALL),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000 * (coalesce(c.n, 0) + 5) // (coalesce(gn.n, 0) + 5 * v.v) AS p,
    1 + 1000000000 * (lc.n + 5) // (ln.n + 5 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang JOIN ln ON ln.lang = g.lang JOIN lc ON lc.lang = k.lang AND lc.term = k.term
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pr.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM grid WHERE n > 0 AND p > q
),
o AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(y.good, 0) AS good, coalesce(y.toxic, 0) AS toxic,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY x) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN y ON y.doc_id = w.doc_id
),
b AS (SELECT 'A' AS f, 1 AS bit UNION ALL SELECT 'B', 2 UNION ALL SELECT 'C', 4 UNION ALL SELECT 'D', 8 UNION ALL SELECT 'E', 16),
o AS (
  SELECT b1.f || b2.f || b3.f || b4.f || b5.f AS filter_order, [b1.bit, b2.bit, b3.bit, b4.bit, b5.bit] AS bits FROM b b1, b b2, b b3, b b4, b b5
  WHERE b1.bit + b2.bit + b3.bit + b4.bit + b5.bit = 31 AND (b1.bit | b2.bit | b3.bit | b4.bit | b5.bit) = 31
),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, CASE WHEN step = 1 THEN 0 ELSE list_sum(bits[1:step - 1]) END AS earlier FROM o, range(1, 6) r(step)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
a AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER ((mask & own) = 0 AND (mask & earlier) = 0), 0) AS kept,
    coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & earlier) = 0), 0) AS removed,
    coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & earlier) <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER ((mask & own) <> 0 AND (mask & earlier) = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER ((mask & own) <> 0 AND (mask & earlier) = 0), 0) AS toxic_lost
  FROM (SELECT part, mask, n, good, toxic, filter_order, step, own, CAST(earlier AS BIGINT) AS earlier FROM m, s) GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a
"""
