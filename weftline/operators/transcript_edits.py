"""Edits of timed transcripts: words and segments split, merged and rebuilt.

words: (segment, pos, word, start, end, score) of one transcript, or of many
with a file_id; edits name a segment and a position, and the file_id where words have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _of(words: DataFrame) -> list[str]:
    """The column that tells transcripts apart, if there is one."""
    return [c for c in ("file_id",) if c in words.columns]


def split_words(words: DataFrame, edits: DataFrame) -> DataFrame:
    """Words with an edit (segment, pos, at) become two, cut after `at` characters; time is shared by length."""
    of = _of(words)
    met = words.join(edits, [*of, "segment", "pos"], "left")
    cut = F.round(F.col("start") + (F.col("end") - F.col("start")) * F.col("at") / F.length("word"), 3)
    left = F.struct(F.substring("word", F.lit(1), F.col("at")).alias("word"), F.col("start").alias("start"), cut.alias("end"), F.lit(0).alias("half"))
    right = F.struct(F.substring("word", F.col("at") + 1, F.length("word")).alias("word"), cut.alias("start"), F.col("end").alias("end"), F.lit(1).alias("half"))
    whole = F.struct(F.col("word").alias("word"), F.col("start").alias("start"), F.col("end").alias("end"), F.lit(0).alias("half"))
    parts = F.when(F.col("at").between(1, F.length("word") - 1), F.array(left, right)).otherwise(F.array(whole))
    each = met.select(*of, "segment", "pos", "score", F.explode(parts).alias("p")).select(*of, "segment", "pos", "p.*", "score")
    return _renumbered(each, "pos", "half")


def merge_words(words: DataFrame, edits: DataFrame) -> DataFrame:
    """A word with an edit (segment, pos) takes in the next one: joined text, its end, the first one's score."""
    of = _of(words)
    by = Window.partitionBy(*of, "segment").orderBy("pos")
    marked = words.join(edits.withColumn("join", F.lit(True)), [*of, "segment", "pos"], "left")
    group = F.sum(F.when(F.coalesce(F.lag("join").over(by), F.lit(False)), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), "")
    merged = marked.withColumn("group", group).groupBy(*of, "segment", "group").agg(text.alias("word"), F.min("start").alias("start"), F.max_by("end", "pos").alias("end"), F.min_by("score", "pos").alias("score"), F.min("pos").alias("pos"))
    return _renumbered(merged, "pos")


def split_segments(words: DataFrame, edits: DataFrame) -> DataFrame:
    """A segment with an edit (segment, pos) is cut before that word; later segments move on by one."""
    of = _of(words)
    marked = words.join(edits.withColumn("cut", F.lit(1)), [*of, "segment", "pos"], "left")
    inside = F.coalesce(F.sum("cut").over(Window.partitionBy(*of, "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return _new_segments(marked.withColumn("part", inside).drop("cut"))


def merge_segments(words: DataFrame, edits: DataFrame) -> DataFrame:
    """A segment with an edit (segment) takes in the next one."""
    of = _of(words)
    starts = words.select(*of, "segment").distinct().join(edits.select(*of, (F.col("segment") + 1).alias("segment"), F.lit(0).alias("new")), [*of, "segment"], "left")
    group = F.sum(F.coalesce("new", F.lit(1))).over(Window.partitionBy(*of).orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)) - 1
    named = starts.select(*of, "segment", group.cast("int").alias("to"))  # one row for each segment of a transcript
    moved = words.join(named, [*of, "segment"]).select(*of, F.col("to").alias("segment"), F.col("segment").alias("old"), "pos", "word", "start", "end", "score")
    return _renumbered(moved, "old", "pos")


def rebuild(words: DataFrame) -> DataFrame:
    """(segment, start, end, text) from the words."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    return words.groupBy(*_of(words), "segment").agg(F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), text.alias("text"))


def _renumbered(rows: DataFrame, *order: str) -> DataFrame:
    of = _of(rows)
    place = (F.row_number().over(Window.partitionBy(*of, "segment").orderBy(*order)) - 1).cast("int")
    return rows.withColumn("new", place).select(*of, "segment", F.col("new").alias("pos"), "word", "start", "end", "score")


def _new_segments(rows: DataFrame) -> DataFrame:
    of = _of(rows)
    parts = rows.select(*of, "segment", "part").distinct()
    named = parts.withColumn("to", (F.row_number().over(Window.partitionBy(*of).orderBy("segment", "part")) - 1).cast("int"))  # one row for each segment
    moved = rows.join(named, [*of, "segment", "part"]).select(*of, F.col("to").alias("segment"), "pos", "word", "start", "end", "score")
    return _renumbered(moved, "pos")
