"""The ten operators as registered queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, html_text, langid, licenses, mixing, near_dedup, quality, sharding, substring_dedup, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SOLID = r"[^\x20\x09-\x0D]+"
#: SQL twins of what SQL can express; random, trained and structural results have brute-force tests.
ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT id, n, array_to_string(w[u.i:u.i + n - 1], ' ') AS g FROM (SELECT id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) u),
dw AS (SELECT doc_id, n, u.i, array_to_string(w[u.i:u.i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) u),
hits AS (SELECT doc_id, n, i, id FROM dw JOIN bw USING (n, g)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT id)) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SOLID}') AS w FROM documents),
g AS (SELECT doc_id, u.i, array_to_string(w[u.i:u.i + 12], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) u),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (g) WHERE doc_id > first),
w AS (SELECT doc_id, u.p, w[u.p] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p) u),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
x AS (SELECT doc_id, unnest(list_transform(range(0, greatest(0, octet_length(t) - 99)), lambda i: {'i': i, 'g': md5_number(array_slice(t, i + 1, i + 100))})) AS x FROM d),
g AS (SELECT doc_id, x.i AS i, x.g AS g FROM x),
f AS (SELECT g, min((doc_id, i)) AS first FROM g GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM g JOIN f USING (g) WHERE (doc_id, i) > first),
n AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
spans AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM k GROUP BY doc_id, run),
parts AS (SELECT doc_id, run, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last, string_agg(hex(array_slice(t, before + 1, lo)), '' ORDER BY run) AS kept FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || hex(array_slice(t, coalesce(last, 0) + 1, octet_length(t))))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)""",
    "op9_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SOLID}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[u.i] || ' ' || w[u.i + 1] END AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w), least(2, len(w) + 1)))) AS i) u),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.root),
k AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)""",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents, by 13-word windows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.verdicts(decontaminate.occurrences(docs, _table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that 13-word windows of earlier documents repeat are cut out."""
    return substring_dedup.digests(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and texts in documents."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of near equal bytes, by a k-d tree over metadata."""
    found = sharding.manifest(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each document gives to a mix of sources at target weights."""
    return mixing.report(_table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of pages under the wrappers of their hosts."""
    found = html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that 100-byte strings repeat from earlier places are cut out."""
    return suffix_dedup.digests(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents, learned from three of four folds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates at a similarity of 0.8 of 2-word shingle sets, as components."""
    return near_dedup.verdicts(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the content share of lines that a trained chain labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(docs, _table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
    return quality.verdicts(quality.measure(docs, weights)).select(columns)


QUERIES["op1_decontaminate"] = op1_decontaminate
QUERIES["op2_substring_dedup"] = op2_substring_dedup
QUERIES["op3_licenses"] = op3_licenses
QUERIES["op4_sharding"] = op4_sharding
QUERIES["op5_mixing"] = op5_mixing
QUERIES["op6_html"] = op6_html
QUERIES["op7_suffix_dedup"] = op7_suffix_dedup
QUERIES["op8_langid"] = op8_langid
QUERIES["op9_near_dedup"] = op9_near_dedup
QUERIES["op10_quality"] = op10_quality
