"""Queries that need a kernel; those without a SQL twin are held by golden and property tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import rules
from weftline.plans import sentence_align as S
from weftline.plans import sequences
from weftline.plans.registry import query
from weftline.session import table


def _spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as reference sentences, and as heard: every seventh word missing, a word each 0.3 s."""
    turns = table(spark, sf_dir, "conversations")
    each = turns.select(F.col("conv_id").alias("file_id"), "turn", F.posexplode(T.sentences("text")).alias("s", "sentence"))
    words = each.select("file_id", "turn", "s", F.posexplode(F.array_remove(F.split(F.trim("sentence"), r"\s+"), "")).alias("w", "word"))
    by = Window.partitionBy("file_id").orderBy("turn", "s", "w")
    refs = words.withColumn("pos", (F.row_number().over(by) - 1).cast("int")).withColumn("sent_idx", (F.dense_rank().over(Window.partitionBy("file_id").orderBy("turn", "s")) - 1).cast("int"))
    refs = refs.select("file_id", "pos", "word", "sent_idx")
    heard = refs.filter("pos % 7 <> 6")
    place = (F.row_number().over(Window.partitionBy("file_id").orderBy("pos")) - 1).cast("int")
    hyps = heard.select("file_id", place.alias("pos"), "word", (F.col("pos") * 0.3).alias("start"), (F.col("pos") * 0.3 + 0.25).alias("end"), F.lit(0.9).alias("conf"))
    return refs, hyps


@query()
def sentence_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of conversations with what was heard of them, times and scores."""
    refs, hyps = _spoken(spark, sf_dir)
    found = S.sentences(S.edits(S.aligned_words(refs, hyps)), refs)
    return found.select("file_id", "sent_idx", "asr", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round("score", 6).alias("score"), F.round("ref_coverage", 6).alias("ref_coverage"))


@query(
    "WITH p AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part) SELECT p_partkey, CAST(levenshtein(a, b) AS BIGINT) AS distance FROM p WHERE b IS NOT NULL"
)
def edit_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit operations between the names of consecutive parts of a brand, counted."""
    after = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", "").alias("a"), F.split(after, "").alias("b")).filter("b is not null")
    return sequences.operations(pairs, "a", "b", ["p_partkey"]).groupBy("p_partkey").agg(F.count_if(F.col("op") != "match").alias("distance"))


@query()
def op_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which characters become which between part types and names."""
    pairs = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_type"), "").alias("a"), F.split("p_name", "").alias("b"))
    return rules.op_counts(sequences.operations(pairs, "a", "b", ["p_partkey"]))


@query()
def edition_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of label 2k against those of label 2k + 1, as two editions in order."""
    vectors = table(spark, sf_dir, "embeddings")
    pairs = vectors.select((F.col("label") - F.col("label") % 2).alias("a")).distinct().withColumn("b", F.col("a") + 1)
    return sequences.align_editions(vectors, "label", "vec_id", "embedding", pairs)


@query()
def ocr_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns read with every fifth word cut short, against the turn."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc"), T.ocr_tokens("text").alias("words"))
    read = turns.withColumn("words", F.transform("words", lambda w, i: F.when(i % 5 == 4, F.substring(w, 1, 3)).otherwise(w)))
    return sequences.align_ocr(read, turns)
