"""The queries op1 to op10 over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, html_extract, license_scan, mixing, quality, sharding, simhash, toxicity, url_filter
from .common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_slots(table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least_cosine=0.98)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.simhash_groups(table(spark, sf_dir, "documents"), width=3, radius=2)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_articles(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= quality.THRESHOLD).alias("keep"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.classify(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", *(f"p_{c}" for c in toxicity.CATEGORIES), "toxic")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_html_extraction": op8_html_extraction,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)

# Patterns of attributes and refreshes, as SQL strings.
_ATTR = r"""'(?is)([^\s"''>/=]+)\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)'"""
_REFRESH = r"""'(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*["'']?\s*(.*?)\s*["'']?\s*$'"""


def _resolved(base: str, reference: str) -> str:
    """SQL for the url that a reference means on a page."""
    ref = f"regexp_replace({reference}, '#.*$', '')"
    part = lambda k: f"regexp_extract({base}, '^([^:/?#]*)(://[^/?#]*)([^?#]*)', {k})"
    own = f"regexp_extract({ref}, '^([^?]*)', 1)"
    path = f"CASE WHEN starts_with({ref}, '/') THEN {own} ELSE regexp_extract(coalesce(nullif({part(3)}, ''), '/'), '^(.*/)[^/]*$', 1) || {own} END"
    parts = f"string_split({path}, '/')"
    parts = f"list_concat({parts}, CASE WHEN regexp_matches({path}, '(^|/)\\.\\.?$') THEN [''] ELSE [] END)"
    walk = "list_reduce(list_transform({}, lambda p: [p]), lambda o, p: CASE p[1] WHEN '.' THEN o WHEN '..' THEN o[1:greatest(len(o) - 1, 1)] ELSE list_concat(o, p) END)".format(parts)
    query = f"regexp_extract({ref}, '^[^?]*(\\?.*)$', 1)"
    return f"""CASE WHEN {base} IS NULL OR instr({base}, '://') = 0 OR {ref} = '' THEN NULL WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {ref}
    WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with({ref}, '//') THEN {part(1)} || ':' || {ref}
    WHEN starts_with({ref}, '?') THEN {part(1)} || {part(2)} || {part(3)} || {query} ELSE {part(1)} || {part(2)} || array_to_string({walk}, '/') || {query} END"""


SQL = {
    "op1_url_filter": rf"""
WITH RECURSIVE rules(v, h, p) AS (VALUES {_RULES}),
tag AS (
  SELECT url AS page, i, tag, lower(substr(tag, 2, 4)) AS kind, list_transform(regexp_extract_all(tag, {_ATTR}, 1), lambda x: lower(x)) AS n,
    list_transform(regexp_extract_all(tag, {_ATTR}, 2), lambda v: regexp_replace(regexp_replace(trim(regexp_replace(v, '^["'']|["'']$', '', 'g')), '&(?:amp|#38|#x26);', '&', 'g'), '[\t\r\n]', '', 'g')) AS v
  FROM (SELECT url, unnest(t) AS tag, generate_subscripts(t, 1) AS i FROM (
    SELECT url, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<(?:script|style|textarea|xmp)\b.*?(?:</(?:script|style|textarea|xmp)\b[^>]*>|\z)', ' ', 'g'),
      '(?is)<(?:link|meta|base)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS t FROM pages WHERE instr(url, '://') > 0))),
base AS (SELECT page, arg_min(v[list_position(n, 'href')], i) AS b FROM tag WHERE kind = 'base' AND list_contains(n, 'href') GROUP BY page),
stated AS (
  SELECT page, CASE WHEN kind = 'link' AND list_contains(string_split_regex(lower(v[list_position(n, 'rel')]), '\s+'), 'canonical') THEN v[list_position(n, 'href')]
    WHEN kind = 'meta' AND lower(v[list_position(n, 'http-equiv')]) = 'refresh' THEN regexp_extract(v[list_position(n, 'content')], {_REFRESH}, 1) END AS r FROM tag),
pair AS (
  SELECT DISTINCT page AS a, {_resolved("coalesce(" + _resolved("page", "b") + ", page)", "r")} AS b FROM stated LEFT JOIN base USING (page) WHERE r <> ''),
whole AS (SELECT url AS u FROM pages UNION SELECT a FROM pair WHERE b IS NOT NULL UNION SELECT b FROM pair WHERE b IS NOT NULL),
part AS (
  SELECT u, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^?#]*(\?[^#]*)', 1) AS query, u IS NOT NULL AND instr(u, '://') > 0 AS ok
  FROM (SELECT u, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS r FROM whole)),
judged AS (
  SELECT u, host, path, CASE WHEN ok THEN host || CASE path WHEN '' THEN '/' ELSE path END || query END AS node,
    (SELECT max_by(v, (length(h || p), length(h))) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS v,
    (SELECT max_by(h || p, (length(h || p), length(h))) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule
  FROM part),
edge AS (
  SELECT x.node AS a, y.node AS b FROM pair JOIN judged x ON x.u = pair.a JOIN judged y ON y.u = pair.b
  UNION SELECT y.node, x.node FROM pair JOIN judged x ON x.u = pair.a JOIN judged y ON y.u = pair.b),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
spread AS (
  SELECT reach.a AS node, bool_or(v = 'block') AND NOT coalesce(bool_or(v = 'allow'), false) AS blocked
  FROM reach JOIN judged ON judged.node = reach.b GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM pages JOIN judged ON judged.u IS NOT DISTINCT FROM pages.url LEFT JOIN spread ON spread.node = judged.node
""",
    "op2_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '') || ':' || coalesce(md5(text), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
c AS (SELECT *, CASE WHEN size < 64 THEN 0 WHEN size < 256 THEN 1 WHEN size < 1024 THEN 2 WHEN size < 4096 THEN 3 ELSE 4 END AS class FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
f AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER o AS k,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST)),
t AS (SELECT source, source_size, CASE WHEN k < coalesce(first_k, 1000000000) THEN cap ELSE first_level * w END AS target
  FROM f, (SELECT min(k) AS first_k, min_by(level, k) AS first_level FROM f WHERE level * w <= cap)),
g AS (SELECT source, class, (8 - class)::DOUBLE AS g, sum(size)::DOUBLE AS words FROM c GROUP BY ALL),
l AS (
  SELECT g.*, source_size, target, (target - 3 * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(g * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY g.source ORDER BY class)),
x AS (SELECT *, min(CASE WHEN level * g <= 3 THEN class END) OVER p AS k, min_by(level, class) FILTER (WHERE level * g <= 3) OVER p AS best FROM l WINDOW p AS (PARTITION BY source)),
e AS (SELECT *, coalesce(CASE WHEN class < coalesce(k, 99) THEN 3.0::DOUBLE ELSE least(best * g, 3.0::DOUBLE) END, 0) AS copies FROM x),
h AS (SELECT *, floor(copies + 1e-9) AS whole, CASE WHEN copies - floor(copies + 1e-9) > 1e-9 THEN copies - floor(copies + 1e-9) ELSE 0 END AS part FROM e),
q AS (SELECT *, target - sum(whole * words) OVER (PARTITION BY source) AS quota FROM h),
r AS (
  SELECT c.doc_id, c.source, c.size, c.class, q.source_size, q.target, q.whole, q.part, q.quota, u * (1 - part) / (u * (1 - part) + (1 - u) * part) AS rank_key
  FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source AND c.class = q.class),
a AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank_key, doc_id) <= quota AS picked FROM r WHERE part > 0 AND size > 0),
b AS (SELECT *, quota - coalesce(sum(size) FILTER (WHERE picked) OVER (PARTITION BY source), 0) AS gap FROM a),
m AS (SELECT source, arg_min(doc_id, (abs(gap - size), rank_key, doc_id)) AS fit FROM b WHERE NOT picked AND abs(gap - size) < gap GROUP BY source)
SELECT r.doc_id, r.size, r.source_size::BIGINT AS source_size, r.target,
  (CASE WHEN r.size = 0 THEN 0 ELSE r.size * (r.whole + CASE WHEN b.picked OR m.fit = r.doc_id THEN 1 ELSE 0 END) END)::BIGINT AS taken
FROM r LEFT JOIN b ON b.doc_id = r.doc_id LEFT JOIN m ON m.source IS NOT DISTINCT FROM r.source
""",
    "op4_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, len(e) AS d, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, c.b) AS component_id, vec_id = least(vec_id, c.b) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
""",
    "op7_decontamination": r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
ik AS (SELECT row_number() OVER () AS k, item_id, w, least(len(w), 5) AS wide FROM i WHERE len(w) > 0),
ish AS (SELECT k, item_id, wide, unnest(list_distinct(list_transform(range(1, len(w) - wide + 2), lambda p: array_to_string(w[p:p + wide - 1], ' ')))) AS s FROM ik),
n AS (SELECT k, count(*) AS n FROM ish GROUP BY k),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
dsh AS (SELECT r, doc_id, unnest(list_distinct(list_transform(range(1, len(w) - wide + 2), lambda p: array_to_string(w[p:p + wide - 1], ' ')))) AS s
  FROM d, (SELECT DISTINCT wide FROM ish) WHERE len(w) >= wide),
hit AS (SELECT doc_id, item_id, r, k, count(*) AS shared FROM dsh JOIN ish USING (s) GROUP BY ALL),
ok AS (SELECT doc_id, item_id, shared, n, shared::DOUBLE / n AS containment FROM hit JOIN n USING (k) WHERE round(shared::DOUBLE / n, 9) >= 0.8)
SELECT doc_id, item_id, max(containment) AS containment, max_by(shared, (containment, shared, n))::BIGINT AS shared, max_by(n, (containment, shared, n))::BIGINT AS n_shingles
FROM ok GROUP BY doc_id, item_id
""",
}
