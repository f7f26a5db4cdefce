"""Queries that run functions and line sources over whole tables, each with its SQL twin."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import geometry
from weftline.functions import phones as P
from weftline.functions import text as T
from weftline.functions.numbers import matching_column
from weftline.operators import joins, rules, trajectory
from weftline.plans import chunk_pipeline
from weftline.plans.registry import query
from weftline.plans.sequences import SIMILARITY_SYMBOLS
from weftline.session import table
from weftline.sources import sinks, tables

_STRIPPED = "lower(regexp_replace({0}, '^[!-/:-@\\[-`{{-~]+|[!-/:-@\\[-`{{-~]+$', '', 'g'))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as line files."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_LINES = "l AS (SELECT CAST(doc_id AS VARCHAR) AS file, u.i - 1 AS line_no, x[u.i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) u)"


@query(
    r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\x0B\f\x{00A0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS cleaned,
  trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) AS collapsed,
  trim(regexp_replace(translate(lower(text), '‘’“”–—', '''''""--'), '[^a-z0-9]+', ' ', 'g')) AS key,
  substr(regexp_replace(trim(text), '[^\p{L}\p{N}_]+', '_', 'g'), 1, 80) AS slug,
  array_to_string(regexp_extract_all(text, '[A-Za-z0-9''‘’‛]+'), ' ') AS ocr_tokens FROM documents
"""
)
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned, collapsed, as lookup keys, slugs and OCR words."""
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text("text").alias("cleaned"), T.collapse("text").alias("collapsed"), T.key_text("text").alias("key"), T.slug("text").alias("slug"), F.array_join(T.ocr_tokens("text"), " ").alias("ocr_tokens"))


@query(
    r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)?([^?#]*)', 1) AS path FROM pages)
SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1)) AS host, CASE WHEN regexp_extract(path, '([^/]*)$', 1) <> '' THEN regexp_extract(path, '([^/]*)$', 1) ELSE md5(url) END AS name,
  nullif(regexp_extract(path, '\b(\d+[A-Za-z]?)\b\s*$', 1), '') AS number, CAST(nullif(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^\s*(\d+)', 1), '') AS INT) AS section FROM u
"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, file names and numbers of URLs."""
    path = F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)?([^?#]*)", 1)
    rows = table(spark, sf_dir, "pages").withColumn("path", path).withColumn("last", F.regexp_extract("path", "([^/]*)$", 1))
    return rows.select("page_id", T.url_host("url").alias("host"), T.url_basename("url").alias("name"), T.trailing_number("path").alias("number"), T.section_numbers("last")["first"].alias("section"))


@query(
    f"""
WITH {_LINES}, w AS (SELECT file, line_no, string_split(line, ' ') AS w FROM l),
p AS (SELECT file, line_no, w[u.i] AS a, w[u.i + 1] AS b FROM w, LATERAL (SELECT unnest(range(1, len(w))) AS i) u)
SELECT CASE WHEN lower(a) = lower(b) THEN 'case' WHEN lower(translate(a, '-''’', '')) = lower(translate(b, '-''’', '')) THEN 'hyphen-apostrophe'
  WHEN {_STRIPPED.format("a")} = {_STRIPPED.format("b")} THEN 'punctuation' ELSE 'normalization' END AS type, count(*) AS n FROM p GROUP BY ALL
"""
)
def normalisation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would turn a word into the next one of its line, counted."""
    return _normalisation_types(_lines(spark, sf_dir))


def _normalisation_types(lines: DataFrame) -> DataFrame:
    """(type, n) of neighbours in lines (line).

    Words that any type but the last one explains are equal once folded and bare
    of punctuation. Whole lines are folded, and only pairs that are equal then
    are typed; the others are counted in place, so that no pair is shuffled.
    """
    folded = F.translate(F.lower("line"), "ς’" + string.punctuation, "σ")  # a last sigma, which depends on what follows, is one like the others
    words = lines.select(F.split("line", " ").alias("w"), F.split(folded, " ").alias("f"))
    alike = F.filter(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.get("f", i - 1) == F.get("f", i))
    found = words.select("w", F.when(F.size("w") > 1, alike).otherwise(F.array().cast("array<int>")).alias("alike"), (F.size("w") - 1).alias("n"))
    typed = F.transform("alike", lambda i: F.struct(T.normalization_type(F.get("w", i - 1), F.get("w", i)).alias("type"), F.lit(1).alias("n")))
    rest = F.array(F.struct(F.lit("normalization").alias("type"), (F.col("n") - F.size("alike")).alias("n")))
    return found.select(F.inline(F.concat(typed, rest))).filter("n > 0").groupBy("type").agg(F.sum("n").alias("n"))


@query(
    f"""
WITH {_LINES}, k AS (SELECT file, line_no, list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda x: x <> '') AS w FROM l),
f AS (SELECT * FROM k WHERE len(w) >= 2), r AS (SELECT w[1] AS id, file, line_no, len(w) - 1 AS n_words FROM f)
SELECT id, CAST(sum(n_words) AS BIGINT) AS n_words, count(*) AS n_lines FROM r GROUP BY id
"""
)
def word_line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read as an id and its words: words and lines of each id."""
    found = tables.kaldi_text(_lines(spark, sf_dir))
    return found.groupBy("id").agg(F.sum(F.size("words")).cast("long").alias("n_words"), F.count("*").alias("n_lines"))


@query(
    f"""
WITH {_LINES}, t AS (SELECT file, line_no, regexp_replace(line, ' ', chr(9)) AS line FROM l),
p AS (SELECT trim(split_part(line, chr(9), 1)) AS id, CAST(file AS BIGINT) * 100000 + line_no AS line_no, trim(substr(line, strpos(line, chr(9)) + 1)) AS sentence FROM t WHERE strpos(line, chr(9)) > 0),
last AS (SELECT id, arg_max(sentence, line_no) AS text FROM p GROUP BY id),
s AS (SELECT id, line_no, row_number() OVER (PARTITION BY id ORDER BY line_no) - 1 AS sent_idx FROM p WHERE sentence <> '')
SELECT id, md5(any_value(text)) AS digest, CAST(max(sent_idx) AS INT) AS last_idx FROM last LEFT JOIN s USING (id) GROUP BY id
"""
)
def tab_line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read as an id and a text: the last text of each id, and how its sentences are numbered."""
    rows = _lines(spark, sf_dir).select((F.col("file").cast("long") * 100000 + F.col("line_no")).alias("line_no"), F.regexp_replace("line", "^([^ ]*) ", "$1\t").alias("line"))
    last = tables.reference_tsv(rows).select("id", F.md5("text").alias("digest"))
    return last.join(tables.sentences_tsv(rows).groupBy("id").agg(F.max("sent_idx").alias("last_idx")), "id", "left")


@query(
    """
WITH e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, CAST(floor(value) AS BIGINT) AS v FROM events),
m AS (SELECT user_id, max(v) AS bandwidth FROM e GROUP BY user_id), b AS (SELECT e.user_id, bandwidth, min(r) AS r FROM e JOIN m USING (user_id) WHERE v = bandwidth GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS file, bandwidth, 'v' || CAST(r AS VARCHAR) || '.m3u8' AS uri FROM b
"""
)
def playlist_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user read as the variants of a master playlist: the best one."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file"), F.row_number().over(by).alias("r"), F.floor("value").alias("v"))
    entry = F.array(F.concat(F.lit("#EXT-X-STREAM-INF:PROGRAM-ID=1,BANDWIDTH="), F.col("v").cast("string")), F.concat(F.lit("v"), F.col("r").cast("string"), F.lit(".m3u8")))
    lines = rows.select("file", F.col("r"), F.posexplode(entry).alias("k", "line")).select("file", (F.col("r") * 2 + F.col("k")).alias("line_no"), "line")
    return tables.variants(lines)


@query(
    """
WITH c AS (SELECT p_partkey, string_split(replace(p_name, ' ', ''), '') AS x FROM part),
p AS (SELECT p_partkey, u.i, x[u.i] AS phone FROM c, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) u),
s AS (SELECT *, CASE WHEN phone IN ('b','d','f','g','k','l','m','n','p','q','r','s','t','v','w','y','z') THEN 'C' ELSE '#' END AS side FROM p),
k AS (SELECT phone, coalesce(lag(side) OVER w, '#') || '_' || coalesce(lead(side) OVER w, '#') AS ctx FROM s WINDOW w AS (PARTITION BY p_partkey ORDER BY i))
SELECT phone, ctx, upper(CASE phone WHEN 'q' THEN '' ELSE phone END) AS target, count(*) AS n FROM k GROUP BY ALL
"""
)
def letter_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of part names as phones: contexts and targets, counted."""
    letters = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split(F.replace("p_name", F.lit(" "), F.lit("")), "")).alias("i", "phone")).filter("phone <> ''")
    found = P.with_context(letters.filter(P.spoken("phone")), ["p_partkey"], "i")
    return found.groupBy("phone", "ctx", P.to_target(F.col("phone")).alias("target")).agg(F.count("*").alias("n"))


@query(
    """
WITH w AS (SELECT conv_id, turn, text AS vv_text, role AS et_text, CASE WHEN turn % 5 = 0 THEN 'c' || CAST(turn AS VARCHAR) END AS classification, role = 'system' AS boilerplate FROM conversations),
g AS (SELECT vv_text, et_text, arg_min(classification, (conv_id, turn)) AS spread FROM w WHERE classification IS NOT NULL AND NOT boilerplate GROUP BY ALL)
SELECT conv_id, turn, coalesce(classification, CASE WHEN NOT boilerplate THEN spread END) AS classification FROM w LEFT JOIN g USING (vv_text, et_text)
"""
)
def spread_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifications of some turns spread to turns of equal text and role."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("segment_index"), F.col("turn").alias("diff_op_index"), F.col("text").alias("vv_text"), F.col("role").alias("et_text"), F.when(F.col("turn") % 5 == 0, F.concat(F.lit("c"), F.col("turn").cast("string"))).alias("classification"), (F.col("role") == "system").alias("boilerplate"))
    return joins.propagate(rows).select(F.col("segment_index").alias("conv_id"), F.col("diff_op_index").alias("turn"), "classification")


@query(
    """
WITH w AS (SELECT p_brand AS word, string_split(p_name, ' ') AS pron FROM part), c AS (SELECT word, pron, count(*) AS c FROM w GROUP BY ALL)
SELECT word, array_to_string(list_transform(list(pron ORDER BY c DESC, pron), lambda p: array_to_string(p, ' ')), ',') AS prons, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY word
"""
)
def pronunciation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as pronunciations of their brand, the most frequent first."""
    words = table(spark, sf_dir, "part").select(F.col("p_brand").alias("word"), F.split("p_name", " ").alias("pron"))
    listed = F.array_join(F.transform("prons", lambda p: F.array_join(p, " ")), ",")
    return rules.pronunciations(words).select("word", listed.alias("prons"), F.col("n").cast("long").alias("n"))


@query(
    """
WITH e AS (SELECT user_id, ts, event_id, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS start, CASE WHEN event_type IN ('error', 'click') THEN CAST(floor(value) AS BIGINT) % 5 END AS src,
  CASE WHEN event_type IN ('error', 'click') THEN CAST(floor(value) AS BIGINT) % 3 END AS dst FROM events),
m AS (SELECT *, CASE WHEN src IS NOT NULL AND lag(src) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY start)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start) AS g FROM m)
SELECT user_id, arg_min(label, start) AS label, min(start) AS start, max(start) + 1 AS "end", arg_min(src, start) AS src, arg_max(dst, start) AS dst FROM g GROUP BY user_id, g
"""
)
def merged_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps, some of them markers: consecutive markers become one."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marker = F.col("event_type").isin("error", "click")
    place = F.row_number().over(by).cast("long")
    steps = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("label"), place.alias("start"), (place + 1).alias("end"), F.when(marker, F.floor("value") % 5).alias("src"), F.when(marker, F.floor("value") % 3).alias("dst"))
    return trajectory.merge_markers(steps, ["user_id"])


@query(
    """
SELECT doc_id, CASE WHEN source = 'src0' THEN 'equal' ELSE 'replace' END AS op, CASE WHEN n_chars % 3 = 0 THEN 'reading' WHEN n_chars % 3 = 1 THEN 'normalisation' END AS classification,
  CASE WHEN n_chars % 3 < 2 AND lang IS NOT NULL THEN lang END AS normalised FROM documents
"""
)
def checked_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as annotated operations whose classes are allowed."""
    kind = F.when(F.col("n_chars") % 3 == 0, "reading").when(F.col("n_chars") % 3 == 1, "normalisation")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src0", "equal").otherwise("replace").alias("op"), kind.alias("classification"), F.concat(F.lit(" "), "lang").alias("normalised"))
    return sinks.checked_annotations(rows)


@query(
    """
SELECT n_nationkey, n_name, coalesce(s, '') AS first_supplier, s IS NULL AS missed FROM nation LEFT JOIN (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS s FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) ON s_nationkey = n_nationkey
"""
)
def lookup_with_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with the first of their rich suppliers, and those that have none."""
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), "s_name", "s_suppkey")
    first = joins.first_wins(rich, ["n_nationkey"], ["s_suppkey"])
    met, missed = joins.with_rejects(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), first, ["n_nationkey"])
    return met.select("n_nationkey", "n_name", F.col("s_name").alias("first_supplier"), F.lit(False).alias("missed")).unionByName(missed.select("n_nationkey", "n_name", F.lit("").alias("first_supplier"), F.lit(True).alias("missed")))


@query("SELECT 0 AS src, t AS dst, t AS ilabel, t AS olabel FROM range(1, 41) r(t) UNION ALL SELECT t, t, t, t FROM range(1, 41) r(t) UNION ALL SELECT t, 0, 0, 0 FROM range(1, 41) r(t) UNION ALL SELECT 0, 0, 0, 0")
def topology_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs of the topology of the usual symbols."""
    return trajectory.ctc_topology(spark, len(SIMILARITY_SYMBOLS))


@query(
    """
WITH o AS (SELECT event_type AS phone, CASE WHEN value < 10 THEN 'deletion' WHEN value < 60 THEN 'substitution' ELSE 'match' END AS op, CASE WHEN value >= 10 AND value < 60 THEN CAST(user_id % 7 AS VARCHAR) END AS target FROM events),
c AS (SELECT phone, op, target, count(*) AS n FROM o GROUP BY ALL), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY phone) AS BIGINT) AS total FROM c)
SELECT phone, op, target, n, total, round(n / total, 6) AS rate FROM r WHERE op <> 'match' AND n >= 5 AND n / total >= 0.01
"""
)
def phone_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms that are frequent whatever their context."""
    value = F.col("value")
    op = F.when(value < 10, "deletion").when(value < 60, "substitution").otherwise("match")
    ops = table(spark, sf_dir, "events").select(F.col("event_type").alias("phone"), op.alias("op"), F.when(op == "substitution", (F.col("user_id") % 7).cast("string")).alias("target"))
    counts = ops.groupBy("phone", "op", "target").agg(F.count("*").alias("n"))
    return rules.rules(counts, ("phone",), min_total=0, min_count=5, min_rate=0.01).withColumn("rate", F.round("rate", 6))


@query(
    """
WITH b AS (SELECT p_partkey, p_size * 1.5 AS x, p_size + 0.9 AS y, p_retailprice / 7 AS w, p_retailprice / 9 AS h FROM part)
SELECT p_partkey, CAST(trunc(x) AS INT) AS "left", CAST(trunc(y) AS INT) + CAST(trunc(h) AS INT) AS bottom, 1000 - CAST(trunc(y + h) AS INT) AS y1, CAST(trunc(x + w) AS INT) AS x2 FROM b
"""
)
def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rectangles on a page of height 1000, under both conventions of the origin."""
    x, y, w, h = F.col("p_size") * 1.5, F.col("p_size") + 0.9, F.col("p_retailprice") / 7, F.col("p_retailprice") / 9
    rows = table(spark, sf_dir, "part").select("p_partkey", geometry.crop(x, y, w, h).alias("c"), geometry.from_bottom(x, y, w, h, F.lit(1000)).alias("b"))
    return rows.select("p_partkey", "c.left", "c.bottom", "b.y1", "b.x2")


@query(
    """
WITH s AS (SELECT conv_id, turn, role, string_split(trim(text), ' ') AS w FROM conversations),
r AS (SELECT conv_id, turn, turn * 1.0 AS start, role = 'system' OR len(list_filter(w, lambda x: x <> '')) = 0 AS decode, len(list_filter(w, lambda x: x <> '')) AS n FROM s)
SELECT conv_id, CASE WHEN decode THEN 'decode' ELSE 'forced' END AS aligner, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_words FROM r GROUP BY ALL
"""
)
def routed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as matched segments: which aligner each would take."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.trim("text").alias("passage"), (F.col("role") == "system").alias("is_boilerplate"), F.lit("ngram").alias("match_method"))
    words = F.size(F.array_remove(F.split("passage", " "), ""))
    return chunk_pipeline.routed(rows).groupBy("conv_id", "aligner").agg(F.count("*").alias("n_segments"), F.sum(words).cast("long").alias("n_words"))


@query(
    """
WITH l AS (SELECT string_split('zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen', ' ') AS o, string_split('twenty thirty forty fifty sixty seventy eighty ninety', ' ') AS t),
s AS (SELECT n, CASE WHEN n < 20 THEN o[n + 1] ELSE t[n // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || o[n % 10 + 1] ELSE '' END END AS w FROM range(0, 100) r(n), l),
h AS (SELECT r.n, CASE WHEN r.n < 100 THEN s.w ELSE o[r.n // 100 + 1] || ' hundred' || CASE WHEN r.n % 100 > 0 THEN ' and ' || s.w ELSE '' END END AS w FROM range(0, 1000) r(n) JOIN s ON s.n = r.n % 100, l)
SELECT p_partkey, 'size ' || a.w || ' no ' || b.w || ' ' || lower(p_name) AS spoken FROM part JOIN h a ON a.n = p_size JOIN h b ON b.n = p_partkey % 1000
"""
)
def spoken_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as they would be read aloud: digits as words, no punctuation."""
    said = F.format_string("Size %d, No. %d: %s!", F.col("p_size").cast("int"), (F.col("p_partkey") % 1000).cast("int"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", matching_column(said).alias("spoken"))


@query(
    """
WITH w AS (SELECT DISTINCT p_name AS word, string_split(upper(p_name), ' ') AS pron FROM part), r AS (SELECT * FROM (VALUES ('WIDGET', 'C_#', 'GADGET', 0), ('COLD', '#_C', NULL, 1), ('SMALL', '#_C', 'TINY', 2), ('WIDGET', 'V_#', 'NEVER', 3)) v(phone, ctx, target, rank)),
s AS (SELECT word, pron, u.i AS site, CASE WHEN u.i = 1 THEN '#' ELSE 'C' END || '_' || CASE WHEN u.i = len(pron) THEN '#' ELSE 'C' END AS ctx FROM w, LATERAL (SELECT unnest(range(1, len(pron) + 1)) AS i) u),
v AS (SELECT word, list_concat(list_concat(pron[1:site - 1], CASE WHEN target IS NULL THEN CAST([] AS VARCHAR[]) ELSE [target] END), pron[site + 1:]) AS pron, site - 1 AS site, rank FROM s JOIN r ON pron[site] = phone AND s.ctx = r.ctx),
e AS (SELECT word, pron, -1 AS site, -1 AS rank FROM w UNION ALL SELECT * FROM v), o AS (SELECT word, array_to_string(pron, ' ') AS pron, min((site, rank)) AS k FROM e GROUP BY ALL)
SELECT word, pron, CAST(row_number() OVER (PARTITION BY word ORDER BY k, pron) - 1 AS INT) AS variant FROM o
"""
)
def context_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-site variants of part names under rules that look at the neighbours."""
    words = table(spark, sf_dir, "part").select(F.col("p_name").alias("word")).distinct().withColumn("pron", F.split(F.upper("word"), " "))
    found = spark.createDataFrame([("WIDGET", "C_#", "GADGET", 0), ("COLD", "#_C", None, 1), ("SMALL", "#_C", "TINY", 2), ("WIDGET", "V_#", "NEVER", 3)], "phone string, ctx string, target string, rank int")
    return rules.apply_rules(words, F.broadcast(found)).withColumn("pron", F.array_join("pron", " "))
