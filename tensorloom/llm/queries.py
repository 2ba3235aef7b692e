"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, htmlrender, langid, linedup, minhash, pii, runs, simhash, suffix, suffixlm, urlrank

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_layout_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlrender.render(table(spark, sf_dir, "pages"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"))


def op5_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_likeness(table(spark, sf_dir, "documents"))


def op6_link_graph_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlrank.judge(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("trust_share", 4).alias("trust_share"), F.round("distrust_share", 4).alias("distrust_share"))


def op7_rare_gram_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_patience_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.remove_blocks(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op11_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixlm.learn_and_score(table(spark, sf_dir, "documents"))


def op12_block_name_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(table(spark, sf_dir, "documents"))


def op13_support_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_weak_pii, op2_string_kernel_language, op3_layout_html, op4_suffix_array, op5_one_permutation_minhash, op6_link_graph_urls, op7_rare_gram_alignment, op8_patience_lines, op9_simhash_trie, op10_byte_bpe, op11_suffix_tree_scores, op12_block_name_runs, op13_support_divergence)
}
#: A byte goes if a 50-byte string that covers it also starts in a document of smaller id. Texts are hexadecimal here.
OP4_SQL = r"""
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), starts AS (
  SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS k FROM docs)
), hits AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS owner FROM starts) WHERE owner < doc_id
), marked AS (
  SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS fresh FROM hits
), runs AS (
  SELECT doc_id, min(k) AS b, max(k) + 50 AS e FROM (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM marked) GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, b, e FROM runs UNION ALL SELECT doc_id, n, n FROM docs
), kept AS (
  SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b, e), 0) AS a FROM cuts
)
SELECT d.doc_id, d.n AS n_bytes, CAST(sum(k.e - k.b) AS BIGINT) AS n_removed, count(*) FILTER (WHERE k.e > k.b) AS n_spans,
       sha256(unhex(string_agg(substr(d.h, 2 * k.a + 1, 2 * (k.b - k.a)), '' ORDER BY k.b, k.e))) AS kept_sha256
FROM docs d JOIN kept k USING (doc_id) GROUP BY d.doc_id, d.n
"""

#: Rules, then personalised PageRank in 120 rounds (damping 0.85) along links and against them, from ruled and from uniform seeds.
OP6_SQL = r"""
WITH RECURSIVE rests AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), pages_of AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rests
), rules(h, p, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS ruled
  FROM (SELECT DISTINCT host, path FROM pages_of) x JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path
), ruled AS (
  SELECT page_id, html, x.host, x.path, rule, ruled FROM pages_of x LEFT JOIN best b ON b.host = x.host AND b.path = x.path
), links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '(?i)\shref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM ruled
), edges AS (
  SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), ways AS (
  SELECT 'trust' AS way, src, dst, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges
), seeds AS (
  SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed, avg(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS blocked FROM ruled WHERE host <> '' GROUP BY host
), hosts AS (
  SELECT way, host, max(seed) AS seed FROM (
    SELECT 'trust' AS way, host, allowed AS seed FROM seeds UNION ALL SELECT 'distrust', host, blocked FROM seeds
    UNION ALL SELECT way, src, 0.0 FROM ways UNION ALL SELECT way, dst, 0.0 FROM ways) x GROUP BY way, host
), moves AS (
  SELECT way, src, dst, w / sum(w) OVER (PARTITION BY way, src) AS p FROM ways
  UNION ALL SELECT way, host, host, CASE WHEN (way, host) IN (SELECT (way, src) FROM ways) THEN 0.0 ELSE 1.0 END FROM hosts
), ranks AS (
  SELECT 0 AS k, way, host, seed AS own, CAST(1 AS DOUBLE) AS every FROM hosts
  UNION ALL
  SELECT r.k + 1, r.way, m.dst, 0.15 * max(h.seed) + 0.85 * sum(m.p * r.own), 0.15 + 0.85 * sum(m.p * r.every)
  FROM ranks r JOIN moves m ON m.way = r.way AND m.src = r.host JOIN hosts h ON h.way = m.way AND h.host = m.dst
  WHERE r.k < 120 GROUP BY r.k, r.way, m.dst
), shares AS (
  SELECT r.host, max(CASE WHEN r.way = 'trust' THEN greatest(own / every, seed) END) AS t, max(CASE WHEN r.way = 'distrust' THEN greatest(own / every, seed) END) AS d
  FROM ranks r JOIN hosts h ON h.way = r.way AND h.host = r.host WHERE k = 120 GROUP BY r.host
)
SELECT page_id, x.host, x.path, x.rule,
       coalesce(x.ruled, CASE WHEN round(coalesce(d, 0), 6) >= 0.5 AND round(coalesce(d, 0), 6) > round(coalesce(t, 0), 6) THEN 'block' ELSE 'allow' END) AS verdict,
       round(coalesce(t, 0), 4) AS trust_share, round(coalesce(d, 0), 4) AS distrust_share
FROM ruled x LEFT JOIN shares s ON s.host = x.host
"""

#: A line goes if it lies in a block of five words or more that a document of smaller id holds too.
OP8_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS p
  FROM documents WHERE text <> ''
), lines AS (
  SELECT doc_id, p, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line,
         len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS w
  FROM split
), solid AS (
  SELECT doc_id, p, w, row_number() OVER d AS k, sum(w) OVER d AS upto FROM lines WHERE line <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), near AS (
  SELECT a.doc_id, a.p AS i, b.p AS j, b.k - a.k AS apart, b.upto - a.upto + a.w AS words
  FROM solid a JOIN solid b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 4
), runs AS (
  SELECT doc_id, i, min(j) AS j FROM near WHERE words >= 5 GROUP BY doc_id, i
  UNION SELECT doc_id, max(i), j FROM near WHERE words >= 5 GROUP BY doc_id, j
  UNION SELECT doc_id, i, j FROM near WHERE words >= 5 AND apart = 1 AND j > i + 1
), held AS (
  SELECT r.doc_id, r.i, r.j, string_agg(l.line, chr(10) ORDER BY l.p) AS run
  FROM runs r JOIN lines l ON l.doc_id = r.doc_id AND l.p BETWEEN r.i AND r.j GROUP BY r.doc_id, r.i, r.j
), gone AS (
  SELECT DISTINCT h.doc_id, l.p
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY run) AS owner FROM held) h
  JOIN lines l ON l.doc_id = h.doc_id AND l.p BETWEEN h.i AND h.j WHERE h.owner < h.doc_id
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_deleted,
         coalesce(string_agg(l.raw, chr(10) ORDER BY l.p) FILTER (WHERE g.p IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted, sha256(coalesce(k.text, d.text)) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

#: Runs by their definition: for each period, islands of words that equal the one a period further. Eight-word strings at a grid of points tell which periods to look at.
OP12_SQL = r"""
WITH crcs AS (
  SELECT doc_id, text, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) AS h FROM documents
), texts AS (
  SELECT doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM crcs
), plans AS (
  SELECT doc_id, ws, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, (h // 10) % 8 + 3 AS parts FROM texts
), words AS (
  SELECT doc_id, n, i, CASE WHEN i >= a THEN ws[1 + a + (i - a) % (1 + (n - a) // parts)] ELSE ws[1 + i] END AS w
  FROM (SELECT *, unnest(range(0, n)) AS i FROM plans)
), grams AS (
  SELECT doc_id, n, i, w, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM words
), periods AS (
  SELECT doc_id, n, q, greatest(24, 3 * q) - q AS need FROM (SELECT doc_id, n, unnest(range(1, n // 3 + 1)) AS q FROM plans)
), points AS (
  SELECT doc_id, q, unnest(range(0, n - q - 7, need - 7)) AS j FROM periods
), hits AS (
  SELECT DISTINCT p.doc_id, p.q FROM points p JOIN grams x ON x.doc_id = p.doc_id AND x.i = p.j JOIN grams y ON y.doc_id = p.doc_id AND y.i = p.j + p.q WHERE x.g = y.g
), same AS (
  SELECT h.doc_id, h.q, x.i, x.i - row_number() OVER (PARTITION BY h.doc_id, h.q ORDER BY x.i) AS island
  FROM hits h JOIN words x ON x.doc_id = h.doc_id JOIN words y ON y.doc_id = x.doc_id AND y.i = x.i + h.q AND y.w = x.w
), runs AS (
  SELECT doc_id, s, l, min(q) AS q FROM (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM same GROUP BY doc_id, q, island) WHERE l >= greatest(24, 3 * q) GROUP BY doc_id, s, l
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(l AS HUGEINT) * 1000000000000 // q DESC, s, q) AS k FROM runs
), listed AS (
  SELECT doc_id, count(*) AS n_runs, max(s) FILTER (WHERE k = 1) AS start, max(l) FILTER (WHERE k = 1) AS length, max(q) FILTER (WHERE k = 1) AS period,
         string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM ranked GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.l
), collapsed AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN dropped d ON d.doc_id = w.doc_id AND d.i = w.i GROUP BY w.doc_id
)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM plans p LEFT JOIN listed l ON l.doc_id = p.doc_id LEFT JOIN collapsed c ON c.doc_id = p.doc_id
"""

#: Divergence by its definition: each pair of sources over all kept terms of their language.
OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), words AS (
  SELECT d, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3
), sizes AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), ps AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * CAST(coalesce(c.n, 0) + 1 AS HUGEINT)) // (t.total + s.v) AS BIGINT) AS p,
         CAST(1 + (1000000000 * CAST(k.n + 1 AS HUGEINT)) // (s.total + s.v) AS BIGINT) AS q
  FROM totals t JOIN sizes s ON s.lang = t.lang JOIN kept k ON k.lang = t.lang LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM ps a JOIN ps b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN gaps x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM ps WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLE_SQL: dict[str, str] = {"op4_suffix_array": OP4_SQL, "op6_link_graph_urls": OP6_SQL, "op8_patience_lines": OP8_SQL, "op12_block_name_runs": OP12_SQL, "op13_support_divergence": OP13_SQL}
