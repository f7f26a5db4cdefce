"""Regions of a text that match a shorter text, by smoothed n-gram density.

For n = 1..MAX_N every n-gram of the text that also occurs in the passage adds
a uniform bump of width n + 2 and weight sqrt(ln(n + 1)) around it; the sum of
the six layers over 3 is the density of a position. Only matched n-grams add
anything, so the density is a sum over matches, not a window over the whole
text: texts without matches cost nothing after the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import matching_words
from weftline.operators.islands import bridge_intervals, longest_interval, number_islands

MAX_N = 6
THRESHOLD = 1.3
MIN_LENGTH = 8
MAX_GAP = 30


def _grams(df: DataFrame, sizes: range, keep: list[str]) -> DataFrame:
    """(keep, n_words, pos, n, gram hash) of the n-grams of all sizes; each word is exploded once."""
    most, count = sizes[-1], F.size("words")
    shifted = [F.slice("words", k + 1, F.greatest(count, F.lit(1))).alias(f"g{k}") for k in range(most)]
    each = df.select(*keep, count.alias("n_words"), F.posexplode(F.arrays_zip(*shifted)).alias("pos", "g"))
    hashed = [F.when(F.col("pos") + n <= F.col("n_words"), F.struct(F.lit(n).alias("n"), F.xxhash64(*[F.col(f"g.g{k}") for k in range(n)]).alias("gram"))) for n in sizes]
    grams = each.filter("pos < n_words").select(*keep, "n_words", "pos", F.explode(F.array(*hashed)).alias("x"))
    return grams.filter("x is not null").select(*keep, "n_words", "pos", "x.n", "x.gram")


def candidates(texts: DataFrame, passages: DataFrame, n: int = MAX_N) -> DataFrame:
    """(text_id, passage_id) that share an n-gram."""
    theirs = _grams(passages, range(n, n + 1), ["passage_id"]).select("passage_id", "gram").distinct()
    return _grams(texts, range(n, n + 1), ["text_id"]).join(theirs, "gram").select("text_id", "passage_id").distinct()


def density(texts: DataFrame, passages: DataFrame, pairs: DataFrame, max_n: int = MAX_N) -> DataFrame:
    """(text_id, passage_id, pos, score) where the score is above zero."""
    sizes = range(1, max_n + 1)
    theirs = _grams(passages, sizes, ["passage_id"]).select("passage_id", "n", "gram").distinct()
    hits = _grams(texts.join(pairs, "text_id"), sizes, ["text_id", "passage_id"]).join(theirs, ["passage_id", "n", "gram"])
    width, last = F.col("n") + 2, F.col("n_words") - F.col("n")
    low = F.greatest(F.col("pos") - F.floor((F.col("n") + 1) / 2), F.lit(0))
    high = F.least(F.col("pos") + F.floor(width / 2), last)
    weight = F.sqrt(F.log(F.col("n") + 1.0)) / width / 3
    spread = hits.filter(last + 1 >= width).select("text_id", "passage_id", "n", weight.alias("w"), F.explode(F.sequence(low, high)).alias("at"))
    placed = spread.select("text_id", "passage_id", (F.col("at") + F.floor((F.col("n") - 1) / 2)).cast("int").alias("pos"), "w")
    return placed.groupBy("text_id", "passage_id", "pos").agg(F.sum("w").alias("score"))


def regions(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(text_id, passage_id, start, end): maximal runs of positions at or over the threshold."""
    keys = ["text_id", "passage_id"]
    high = scores.filter(F.col("score") >= threshold)
    by = Window.partitionBy(*keys).orderBy("pos")
    marked = number_islands(high, keys, ["pos"], F.col("pos") - F.lag("pos").over(by) > 1)
    return marked.groupBy(*keys, "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("island")


def passage_regions(docs: DataFrame, passages: DataFrame, doc_id: str, doc_text: str, passage_id: str, passage_text: str) -> DataFrame:
    """(text_id, passage_id, start, end): the longest bridged region of each document and passage."""
    texts = docs.select(F.col(doc_id).alias("text_id"), matching_words(doc_text).alias("words"))
    short = passages.select(F.col(passage_id).alias("passage_id"), matching_words(passage_text).alias("words"))
    found = regions(density(texts, short, candidates(texts, short)))
    keys = ["text_id", "passage_id"]
    return longest_interval(bridge_intervals(found, keys, min_length=MIN_LENGTH, max_gap=MAX_GAP), keys)


def match_cascade(exact: DataFrame, fuzzy: DataFrame, chunks: DataFrame, boilerplate: int = 40) -> DataFrame:
    """Each chunk's region: n-gram (score 100), else fuzzy (its score), else none (0, boilerplate)."""
    met = chunks.join(exact.withColumn("exact", F.lit(100.0)), "chunk_id", "left").join(fuzzy, "chunk_id", "left")
    score = F.coalesce("exact", "fuzzy_score", F.lit(0.0))
    method: Column = F.when(F.col("exact").isNotNull(), "ngram").when(F.col("fuzzy_score").isNotNull(), "fuzzy").otherwise("none")
    return met.withColumn("match_score", score).withColumn("match_method", method).withColumn("is_boilerplate", score < boilerplate)
