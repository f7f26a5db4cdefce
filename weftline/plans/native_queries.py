"""Queries that are DataFrame operations alone, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.vectors import similar_pairs
from weftline.operators import islands, joins, regions, rules, trajectory
from weftline.plans.registry import query
from weftline.session import table

_MATCHING = r"list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(text),'-',' ','g'),'[^\p{L}\p{N}_\s]','','g'),'\s+',' ','g')),' '), lambda x: x <> '')"


@query(
    f"""
WITH t AS (SELECT doc_id, {_MATCHING} AS w FROM documents), b AS (SELECT item_id, {_MATCHING} AS w FROM benchmark),
sizes AS (SELECT unnest(range(1, 7)) AS n),
dg AS (SELECT doc_id, n, len(w) - n + 1 AS m, u.i - 1 AS pos, array_to_string(w[u.i:u.i + n - 1], ' ') AS g
       FROM t, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) u),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[u.i:u.i + n - 1], ' ') AS g
       FROM b, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) u),
pairs AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (n, g) WHERE n = 6),
hits AS (SELECT doc_id, item_id, n, m, pos FROM pairs JOIN dg USING (doc_id) JOIN bg USING (item_id, n, g) WHERE m >= n + 2),
spread AS (SELECT doc_id, item_id, v.at + (n - 1) // 2 AS pos, sqrt(ln(n + 1)) / (n + 2) / 3 AS w
           FROM hits, LATERAL (SELECT unnest(range(greatest(pos - (n + 1) // 2, 0), least(pos + (n + 2) // 2, m - 1) + 1)) AS at) v),
scores AS (SELECT doc_id, item_id, pos, sum(w) AS s FROM spread GROUP BY ALL HAVING sum(w) >= 1.3),
i1 AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS k FROM scores),
runs AS (SELECT doc_id, item_id, min(pos) AS s, max(pos) + 1 AS e FROM i1 GROUP BY doc_id, item_id, k HAVING max(pos) + 1 - min(pos) >= 8),
i2 AS (SELECT *, CASE WHEN s - lag(e) OVER w > 30 OR lag(e) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM runs WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY s)),
i3 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY s) AS k FROM i2),
joined AS (SELECT doc_id, item_id, min(s) AS s, max(e) AS e FROM i3 GROUP BY doc_id, item_id, k),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY e - s DESC, s) AS r FROM joined)
SELECT doc_id, item_id, s AS first_word, e AS end_word FROM best WHERE r = 1
"""
)
def passage_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents hold passages of the benchmark set, by n-gram density."""
    found = regions.passage_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    return found.select(F.col("text_id").alias("doc_id"), F.col("passage_id").alias("item_id"), F.col("start").cast("long").alias("first_word"), F.col("end").cast("long").alias("end_word"))


@query(
    r"""
WITH w AS (SELECT unnest(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS w FROM documents),
n AS (SELECT lower(regexp_replace(translate(w, '-''’', ''), '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')) AS token FROM w)
SELECT token, count(*) AS n FROM n WHERE token <> '' GROUP BY token
"""
)
def normalized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised words of all documents with their counts."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("w"))
    counted = words.groupBy("w").agg(F.count("*").alias("n"))  # normalise each spelling once
    return counted.select(T.normalize_word("w").alias("token"), "n").filter("token <> ''").groupBy("token").agg(F.sum("n").alias("n"))


@query(r"SELECT doc_id, CAST(u.i - 1 AS INT) AS sent_idx, s[u.i] AS sentence FROM (SELECT doc_id, string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) u")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents with their index."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("sent_idx", "sentence"))


@query(
    """
WITH c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents)
SELECT ch, CASE WHEN regexp_matches(ch, '[ꝺꝼᵹꝽꝿꞁꞃꞅꞇ]') THEN 'insular' WHEN regexp_matches(ch, '[ḂḃĊċḊḋḞḟĠġṀṁṖṗṠṡṪṫ]') THEN 'dotted'
  WHEN regexp_matches(ch, '[ÁÉÍÓÚáéíóú]') THEN 'accented' WHEN regexp_matches(ch, '[A-Za-z]') THEN 'letter' WHEN regexp_matches(ch, '[0-9]') THEN 'digit' ELSE 'other' END AS class, count(*) AS n
FROM c WHERE ch <> '' GROUP BY ch
"""
)
def char_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of all documents, classed, with their counts."""
    return rules.char_inventory(table(spark, sf_dir, "documents"), "text")


@query(
    """
WITH e AS (SELECT user_id, ts, event_id, CAST(floor(epoch(ts)) AS DOUBLE) AS s, event_type FROM events),
m AS (SELECT *, CASE WHEN abs(s - lag(s) OVER w) >= 21600 OR lag(s) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m)
SELECT user_id, min(s) AS start, max(s) AS "end", count(*) AS n_rows, string_agg(event_type, ' ' ORDER BY ts, event_id) AS event_type FROM k GROUP BY user_id, island
"""
)
def contiguous_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user less than six hours apart, merged."""
    seconds = F.unix_timestamp("ts").cast("double")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", seconds.alias("start"), seconds.alias("end"))
    return islands.merge_contiguous(events, ["user_id"], ["ts", "event_id"], "start", "end", "event_type", gap=6 * 3600).drop("island")


@query(
    """
WITH m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, min(ts) AS first, max(ts) AS last, count(*) AS length FROM k GROUP BY user_id, run
"""
)
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal event types of each user."""
    return islands.run_lengths(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


_OPS_SQL = """
ops AS (SELECT 'DR' || CAST(user_id % 8 + 1 AS VARCHAR) AS dialect, event_type AS phone, coalesce(lag(event_type) OVER w, '#') || '_' || coalesce(lead(event_type) OVER w, '#') AS ctx,
  CASE WHEN value < 10 THEN 'deletion' WHEN value < 20 THEN 'insertion' WHEN value < 60 AND lead(event_type) OVER w <> event_type THEN 'substitution' ELSE 'match' END AS op,
  CASE WHEN value >= 20 AND value < 60 AND lead(event_type) OVER w <> event_type THEN lead(event_type) OVER w END AS target
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as edit operations: type as phone, neighbours as context, the value decides the operation."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    after, value = F.lead("event_type").over(by), F.col("value")
    swapped = (value >= 20) & (value < 60) & (after != F.col("event_type"))
    op = F.when(value < 10, "deletion").when(value < 20, "insertion").when(swapped, "substitution").otherwise("match")
    ctx = F.concat_ws("_", F.coalesce(F.lag("event_type").over(by), F.lit("#")), F.coalesce(after, F.lit("#")))
    dialect = F.concat(F.lit("DR"), (F.col("user_id") % 8 + 1).cast("string"))
    return table(spark, sf_dir, "events").select(dialect.alias("dialect"), F.col("event_type").alias("phone"), ctx.alias("ctx"), op.alias("op"), F.when(swapped, after).alias("target"))


@query(
    f"""WITH {_OPS_SQL} SELECT dialect, phone, ctx, op, target, count(*) AS n, CASE WHEN grouping(dialect) = 1 THEN 'all' ELSE 'by' END AS level
FROM ops WHERE op <> 'insertion' GROUP BY GROUPING SETS ((phone, ctx, op, target), (dialect, phone, ctx, op, target))"""
)
def context_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations by phone and context, over all and by dialect, in one scan."""
    return rules.context_counts(_ops(spark, sf_dir), "dialect")


def _rules_sql(keys: str, least: int, count: int) -> str:
    return f"""WITH {_OPS_SQL}, c AS (SELECT {keys}, op, target, count(*) AS n FROM ops WHERE op <> 'insertion' GROUP BY ALL),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {keys}) AS BIGINT) AS total FROM c)
SELECT {keys}, op, target, n, total, round(n / total, 6) AS rate FROM r WHERE total >= {least} AND op <> 'match' AND n >= {count} AND n / total >= 0.02"""


@query(_rules_sql("phone, ctx", 10, 5))
def context_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms that are frequent in their context."""
    return rules.rules(rules.context_counts(_ops(spark, sf_dir))).withColumn("rate", F.round("rate", 6))


@query(_rules_sql("dialect, phone, ctx", 5, 3))
def segment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms that are frequent in their context within a dialect."""
    counts = rules.context_counts(_ops(spark, sf_dir), "dialect").filter("level = 'by'").drop("level")
    return rules.rules(counts, ("dialect", "phone", "ctx"), 5, 3).withColumn("rate", F.round("rate", 6))


@query(
    f"""WITH {_OPS_SQL}, c AS (SELECT phone, op, target, count(*) AS n FROM ops WHERE op <> 'insertion' GROUP BY ALL),
r AS (SELECT *, sum(CASE WHEN op IN ('match', 'substitution') THEN n ELSE 0 END) OVER w AS seen, sum(n) OVER w AS every FROM c WINDOW w AS (PARTITION BY phone))
SELECT phone, op, target, n, round(CASE op WHEN 'substitution' THEN n / seen WHEN 'deletion' THEN n / every END, 6) AS rate FROM r"""
)
def display_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates as shown: deletions and substitutions over different sums."""
    counts = _ops(spark, sf_dir).filter("op <> 'insertion'").groupBy("phone", "op", "target").agg(F.count("*").alias("n"))
    return rules.display_rates(counts).withColumn("rate", F.round("rate", 6))


@query(
    """
WITH e AS (SELECT user_id, event_type AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS start,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) % 5 END AS dst FROM events),
l AS (SELECT *, sum(CASE WHEN dst IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start) AS leg FROM e),
s AS (SELECT *, coalesce(last_value(dst IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + coalesce(sum(CASE WHEN dst IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, leg ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS state FROM l),
p AS (SELECT user_id, label, start, state, row_number() OVER (PARTITION BY user_id, state ORDER BY start) > 1 AS seen,
  min(state) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least,
  coalesce(lag(state + 1) OVER (PARTITION BY user_id ORDER BY start), -1) AS prev FROM s WHERE dst IS NULL),
v AS (SELECT *, CASE WHEN seen THEN 'repetition' WHEN state < least THEN 'insertion' ELSE 'normal' END AS variation FROM p)
SELECT user_id, CAST(start AS BIGINT) AS start, label, CAST(state AS BIGINT) AS state, variation FROM v
UNION ALL SELECT user_id, CAST(start AS BIGINT), NULL, CAST(greatest(prev, 0) AS BIGINT), 'deletion' FROM v WHERE state > prev + 1 AND NOT seen AND state >= coalesce(least, state)
"""
)
def state_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a walk over states: purchases jump, others step on; each step classified."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    place = (F.row_number().over(by) - 1).cast("long")
    jump = F.when(F.col("event_type") == "purchase", F.floor("value") % 5)
    steps = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("label"), place.alias("start"), (place + 1).alias("end"), jump.alias("dst"))
    walked = trajectory.states(steps, ["user_id"]).filter("dst is null")
    return trajectory.variations(walked, ["user_id"]).select("user_id", "start", "label", F.col("state").cast("long").alias("state"), "variation")


@query(
    """
SELECT o_orderkey, count(l_linenumber) AS n_inside, CAST(sum(l_linenumber) AS BIGINT) AS line_sum FROM orders
LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 365 DAY GROUP BY o_orderkey
"""
)
def contained_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items shipped within a year of their order: intervals inside intervals."""
    day = lambda c: F.unix_seconds(F.col(c).cast("timestamp")) / 86400
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), day("o_orderdate").alias("start"), (day("o_orderdate") + 365).alias("end"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), day("l_shipdate").alias("i_start"), day("l_shipdate").alias("i_end"), "l_linenumber")
    found = joins.contained(orders, lines, ["k"])
    return found.groupBy(F.col("k").alias("o_orderkey")).agg(F.count("l_linenumber").alias("n_inside"), F.sum("l_linenumber").cast("long").alias("line_sum"))


@query("SELECT n_name, r_name, count(c_custkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name")
def dialect_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation, nations without any included; customers are counted before the join."""
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", "r_name", F.coalesce("c", F.lit(0)).alias("n"))


@query(
    """
WITH c AS (SELECT p_brand, l_returnflag || '>' || l_linestatus || ' ' || p_type AS transform, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, transform) AS place FROM c) SELECT p_brand, transform, n, place FROM r WHERE place <= 3
"""
)
def topk_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent status changes of each brand; ties by name."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("c"))
    met = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    named = met.withColumn("transform", F.concat("l_returnflag", F.lit(">"), "l_linestatus", F.lit(" "), "p_type"))
    return rules.top_per_key(named.groupBy("p_brand", "transform").agg(F.sum("c").alias("n")), ["p_brand"], 3, "n", ["transform"])


@query("SELECT n_name, arg_max(s_name, (s_acctbal, -s_suppkey)) AS best, max(s_acctbal) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of the highest balance in each nation, the first of equals."""
    met = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return met.groupBy("n_name").agg(F.max_by("s_name", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("best"), F.max("s_acctbal").alias("balance"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest, arg_min(source, doc_id) AS source FROM documents GROUP BY md5(text)")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text; only digests are shuffled."""
    digests = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), "source")
    return joins.first_wins(digests, ["digest"], ["doc_id"])


@query("SELECT source, lang, arg_max(doc_id, doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source, lang")
def last_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last document of each source and language."""
    docs = table(spark, sf_dir, "documents").withColumn("order", F.col("doc_id"))
    return joins.last_wins(docs, ["source", "lang"], "order", ["doc_id", "n_chars"])


@query("SELECT event_id, user_id, event_type FROM events e WHERE ts >= TIMESTAMP '2024-01-02' AND NOT EXISTS (SELECT 1 FROM events k WHERE k.ts < TIMESTAMP '2024-01-02' AND k.user_id = e.user_id AND k.event_type = e.event_type)")
def unseen_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose user and type had not been seen before the second day."""
    events = table(spark, sf_dir, "events")
    cut = F.lit("2024-01-02").cast("timestamp")
    return joins.unseen(events.filter(F.col("ts") >= cut), events.filter(F.col("ts") < cut), ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query(
    """
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.2
"""
)
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar vectors of one label."""
    return similar_pairs(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.2).withColumn("sim", F.round("sim", 6))


@query(
    """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN p <= floor(n * 0.9) THEN 'train' WHEN p <= floor(n * 0.9) + floor(n * 0.05) THEN 'val' ELSE 'test' END AS split FROM r
"""
)
def doc_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in train, val and test of exact sizes."""
    return joins.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(
    """
WITH t AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, split_part(p_name, ' ', 1) AS word, split_part(p_name, ' ', 2) || substr(p_name, 1, 2) AS ref_word FROM part),
m AS (SELECT a.p_brand, a.pos, a.word, b.pos AS ref_pos, b.ref_word, levenshtein(lower(a.word), lower(b.ref_word)) AS distance FROM t a JOIN t b ON a.p_brand = b.p_brand AND b.pos >= a.pos - 20 AND b.pos < a.pos + 20),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, pos ORDER BY distance, CASE WHEN ref_pos < pos THEN 1 ELSE 0 END, abs(ref_pos - pos)) AS k FROM m WHERE distance <= 5)
SELECT t.p_brand, CAST(t.pos AS INT) AS pos, t.word, CAST(r.ref_pos AS INT) AS ref_pos, r.ref_word, CAST(r.distance AS INT) AS distance FROM t LEFT JOIN r ON t.p_brand = r.p_brand AND t.pos = r.pos AND r.k = 1
"""
)
def fuzzy_window_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest similar word within twenty places."""
    place = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("pos")
    parts = table(spark, sf_dir, "part").select("p_brand", place, "p_name")
    words = parts.select("p_brand", "pos", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"))
    reference = parts.select("p_brand", F.col("pos").alias("ref_pos"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.substring("p_name", 1, 2)).alias("ref_word"))
    return joins.nearest_in_window(words, reference, ["p_brand"], edits=5)


@query(
    """
SELECT conv_id, turn, role, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS asked_in FROM conversations
"""
)
def turn_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the user's turn that it belongs to."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.col("turn")).alias("asked_in"))
    return islands.forward_fill(turns, ["conv_id"], ["turn"], "asked_in", F.lit(0))


@query(
    """
WITH w AS (SELECT DISTINCT p_name AS word, string_split(upper(p_name), ' ') AS pron FROM part), r AS (SELECT * FROM (VALUES ('WIDGET', 'GADGET', 0), ('COLD', NULL, 1), ('SMALL', 'TINY', 2), ('WIDGET', NULL, 3)) v(phone, target, rank)),
s AS (SELECT word, pron, u.i AS site FROM w, LATERAL (SELECT unnest(range(1, len(pron) + 1)) AS i) u),
v AS (SELECT word, list_concat(list_concat(pron[1:site - 1], CASE WHEN target IS NULL THEN CAST([] AS VARCHAR[]) ELSE [target] END), pron[site + 1:]) AS pron, site - 1 AS site, rank FROM s JOIN r ON pron[site] = phone),
e AS (SELECT word, pron, -1 AS site, -1 AS rank FROM w UNION ALL SELECT * FROM v), o AS (SELECT word, array_to_string(pron, ' ') AS pron, min((site, rank)) AS k FROM e GROUP BY ALL)
SELECT word, pron, CAST(row_number() OVER (PARTITION BY word ORDER BY k, pron) - 1 AS INT) AS variant FROM o
"""
)
def variant_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-site variants of part names under a few rules."""
    words = table(spark, sf_dir, "part").select(F.col("p_name").alias("word")).distinct().withColumn("pron", F.split(F.upper("word"), " "))
    found = spark.createDataFrame([("WIDGET", "GADGET", 0), ("COLD", None, 1), ("SMALL", "TINY", 2), ("WIDGET", None, 3)], "phone string, target string, rank int")
    return rules.apply_rules(words, F.broadcast(found), contexts=False).withColumn("pron", F.array_join("pron", " "))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\s\x{00A0}]+', ' ', 'g')) AS title, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1)) AS host FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and hosts of pages."""
    return table(spark, sf_dir, "pages").select("page_id", T.html_title("html").alias("title"), T.url_host("url").alias("host"))


@query("""SELECT page_id, CAST(u.i - 1 AS INT) AS place, l[u.i] AS link FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages in page order."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(links).alias("place", "link"))


@query("SELECT d.doc_id, l.quality, l.toxic, (quality IS NOT NULL AND quality = 1) OR coalesce(n_chars >= 2000, false) AS validated FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def quality_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's label, or else its length, validates it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", "quality", "toxic", joins.validated(F.coalesce(F.col("quality"), F.lit(0)) * 1.0, F.col("n_chars"), 2000).alias("validated"))


@query("SELECT event_id, ts, event_type AS class FROM events WHERE event_type IN ('purchase', 'click')")
def interleave_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two event lists as one in time order."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("class"))
    return joins.interleave(events.filter(F.col("class") == "purchase"), events.filter(F.col("class") == "click"), "ts")


@query(r"SELECT conv_id, md5(string_agg(text, chr(10) || chr(12) || chr(10) ORDER BY turn)) AS digest, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def region_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a conversation joined in order by form feeds."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(texts, "\n\f\n")).alias("digest"), F.count("*").alias("n_turns"))


@query("SELECT conv_id, arg_min(role, turn) AS role, bool_or(role = 'system') AS boilerplate, row_number() OVER (ORDER BY conv_id) - 1 AS index FROM conversations GROUP BY conv_id")
def regroup_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation: first role, whether any turn is the system's, new index."""
    turns = table(spark, sf_dir, "conversations").withColumn("boilerplate", F.col("role") == "system")
    return joins.regroup(turns, "conv_id", "turn", ["role"], "boilerplate")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals by type; the batch form of the streaming window."""
    by_day = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w"))
    return by_day.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select("event_type", F.col("w.start").alias("day"), "n", "total")
