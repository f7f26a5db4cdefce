"""From matched chunks of a recording to timed words: mismatches, spans, the choice of aligner, results."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from weftline.functions import text as T
from weftline.operators import trajectory
from weftline.plans import sequences

_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


@F.pandas_udf(_SPANS)
def word_spans(text: pd.Series, words: pd.Series) -> pd.Series:
    """Character span of each word, found one after another; a word that is missing starts where the last one ended."""

    def one(t: str, found: list[str]) -> list[dict]:
        at, out = 0, []
        for w in found:
            start = t.find(w, at)
            start = at if start < 0 else start
            at = start + len(w)
            out.append({"start": start, "end": at})
        return out

    return pd.Series([one(t, list(w)) if t is not None and w is not None else None for t, w in zip(text, words, strict=True)])


def char_span(spans: str, first: str, end: str, text: str) -> F.Column:
    """(start, end) characters of the words first..end-1; the whole text where a bound is no word."""
    start = F.get(spans, F.col(first))["start"]
    stop = F.when(F.col(end) > 0, F.get(spans, F.greatest(F.col(end) - 1, F.lit(0)))["end"])
    return F.struct(F.coalesce(start, F.lit(0)).alias("start"), F.coalesce(stop, F.char_length(text)).alias("end"))


def mismatches(segments: DataFrame) -> DataFrame:
    """(file_id, chunk, start, end, text, passage, diff) where a chunk's text differs from the passage it matches."""
    differs = (F.col("passage") != "") & ~F.col("is_boilerplate") & (T.matching_text("text") != T.matching_text("passage"))
    return segments.filter(differs).select("file_id", "chunk", "start", "end", "text", "passage", sequences.line_diff("text", "passage").alias("diff"))


def routed(segments: DataFrame) -> DataFrame:
    """Adds aligner: decode for boilerplate, unmatched and empty passages, else forced."""
    words = F.array_remove(F.split(F.trim(F.coalesce("passage", F.lit(""))), r"\s+"), "")
    decode = F.col("is_boilerplate") | (F.col("match_method") == "none") | (F.size(words) == 0)
    return segments.withColumn("aligner", F.when(decode, "decode").otherwise("forced"))


def absolute(words: DataFrame, segments: DataFrame, keys: Sequence[str] = ("file_id", "chunk")) -> DataFrame:
    """Word times within a segment as times of the recording, three decimals."""
    offsets = segments.select(*keys, F.col("start").alias("weftline_offset"))
    met = words.join(offsets, list(keys))
    shifted = lambda c: F.round(F.col(c) + F.col("weftline_offset"), 3)
    return met.withColumn("start", shifted("start")).withColumn("end", shifted("end")).drop("weftline_offset")


def timed_words(segments: DataFrame, forced: DataFrame, decoded: DataFrame, keys: Sequence[str] = ("file_id", "chunk")) -> DataFrame:
    """(keys, pos, word, start, end, conf) of every segment by its aligner, in times of the recording.

    forced, decoded: words with times within the segment, of the segments that each aligner was given.
    """
    chosen = routed(segments)
    of = lambda name, words: words.join(chosen.filter(F.col("aligner") == name).select(*keys), list(keys), "left_semi")
    return absolute(of("forced", forced).unionByName(of("decode", decoded)), segments, keys)


def results(segments: DataFrame, words: DataFrame, keys: Sequence[str] = ("file_id", "chunk")) -> DataFrame:
    """(keys, start, end, passage, text, words, boilerplate): segments with their words, matching details left out."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word", "start", "end", "conf"))), lambda x: x.dropFields("pos"))
    grouped = words.groupBy(*keys).agg(listed.alias("words"))
    met = segments.join(grouped, list(keys), "left")
    none = F.expr("cast(array() as array<struct<word:string,start:double,end:double,conf:double>>)")
    return met.select(*keys, "start", "end", "passage", "text", F.coalesce("words", none).alias("words"), F.col("is_boilerplate").alias("boilerplate"))


def with_words(segments: DataFrame) -> DataFrame:
    """Segments that have words."""
    return segments.filter(F.size("words") > 0)


def self_align(frames: DataFrame, symbols: Sequence[str], blank: int = 0, shift: float = 0.02) -> DataFrame:
    """(utt_id, place, token, start, end, conf) without a transcript: the best symbols of the frames, aligned to the frames.

    frames: (utt_id, t, logits).
    """
    best = F.expr("array_position(logits, array_max(logits))").cast("int") - 1
    names = F.array(*[F.lit(s) for s in symbols])
    labels = frames.select("utt_id", "t", F.element_at(names, best + 1).alias("label"), best.alias("code"))
    runs = trajectory.label_runs(labels.select("utt_id", "t", F.col("code").cast("string").alias("label")), ["utt_id"], drop=(str(blank),))
    tokens = runs.groupBy("utt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "label"))), lambda x: x["label"].cast("int")).alias("tokens"))
    found = sequences.force_align(frames, tokens, blank, shift)
    return found.withColumn("token", F.element_at(names, F.col("token") + 1))
