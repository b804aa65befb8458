"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm import bpe, decontaminate, langid, license_scan, minhash, quality_model, quality_rules, secret_scan, substring_dedup, url_filter



def _tokenizer() -> str:
    """The path of the vocabulary file, from the package of public tokenizers where it is installed."""
    try:
        import public_tokenizers
    except ImportError:
        return "/opt/tokenizers/word_bpe_49k.json"
    return public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = os.environ.get("SPANFRAME_TOKENIZER") or str(_tokenizer())
URL_RULES = [url_filter.parse_rule(*r) for r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_report(_table(spark, sf_dir, "documents"), TOKENIZER)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(_table(spark, sf_dir, "documents"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_decontaminate, op3_language_id, op4_minhash_dedup, op5_substring_dedup, op6_secret_scan, op7_bpe, op8_quality_rules, op9_quality_model, op10_url_filter)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"list_filter(string_split_regex({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_SPACE = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER)} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM.format(_LOWER)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') FOR i IN range(1, greatest(len(w) - 9, 1) + 1)]) AS s FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
run AS (SELECT doc_id, k, unnest([{{'i': i, 's': array_to_string(w[i:i + k - 1], ' ')}} FOR i IN range(1, len(w) - k + 2)], recursive := true) FROM d, sizes WHERE len(w) >= k),
hit AS (SELECT run.doc_id, run.i, run.k, win.item_id FROM run JOIN win USING (k, s)),
word AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit),
nh AS (SELECT doc_id, count(*) AS n_hit FROM word GROUP BY doc_id),
ni AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)""",
    "op4_minhash_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACE.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS x FROM d),
n AS (SELECT doc_id, len(x)::BIGINT AS n FROM s),
sh AS (SELECT doc_id, unnest(x) AS h FROM s),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b USING (h) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM pair JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 85 * (nu.n + nv.n - c)),
e AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, e.v FROM reach JOIN e ON e.u = reach.b)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""",
    "op5_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_SPACE.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, unnest([{{'i': i, 's': array_to_string(w[i:i + 19], ' ')}} FOR i IN range(1, len(w) - 18)], recursive := true) FROM d WHERE len(w) >= 20),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE r > 1),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [w[j] FOR j IN range(1, len(w) + 1) IF NOT list_contains(ps, j)] END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)""",
    "op10_url_filter": r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(verdict, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, host, path, verdict, h || q AS rule, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || q) DESC) AS k
  FROM (SELECT DISTINCT page_id, host, path FROM p) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.host = p.host AND m.path = p.path AND m.k = 1""",
}
