"""Transcript readers: JSON of several shapes into one table of timed words.

Every reader gives (file_id, pos, word, start, end, conf) with pos from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = "segments array<struct<start:double,end:double,text:string,words:array<struct<word:string,start:double,end:double,score:double>>>>"
SEGMENTS = "array<map<string,string>>"
CHUNKS = "chunks array<struct<text:string,timestamp:array<double>>>"


def read_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(file_id, json) of each file below a path; the id is the name without its suffix. Fails if there is none."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    found = files.select(file_stem(F.input_file_name()).alias("file_id"), F.input_file_name().alias("path"), F.col("value").alias("json"))
    if found.isEmpty():
        raise FileNotFoundError(f"no {pattern} below {path}")
    return found


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, path, html) of the .html and .htm files below a path, whatever their case, in the order of their paths."""
    return read_files(spark, path, "*.{html,htm,HTML,HTM,Html,Htm}").select("file_id", "path", F.col("json").alias("html")).orderBy("path")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _either(segment: str, first: str, second: str) -> Column:
    """The value of a segment under either of two keys."""
    return F.coalesce(F.try_element_at(segment, F.lit(first)), F.try_element_at(segment, F.lit(second)))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(*order)) - 1
    return rows.withColumn("pos", place.cast("int")).select("file_id", "pos", "word", "start", "end", "conf")


def words_json(files: DataFrame) -> DataFrame:
    """Word-level transcripts: missing starts are 0, missing ends the start, missing scores 1; empty words drop."""
    parsed = files.select("file_id", F.from_json("json", WORDS).alias("j"))
    segments = parsed.select("file_id", F.posexplode("j.segments").alias("s", "seg"))
    each = segments.select("file_id", "s", F.posexplode("seg.words").alias("w", "x"))
    start = F.coalesce("x.start", F.lit(0.0))
    rows = each.select("file_id", "s", "w", F.trim("x.word").alias("word"), start.alias("start"), F.coalesce("x.end", start).alias("end"), F.coalesce("x.score", F.lit(1.0)).alias("conf"))
    return _numbered(rows.filter("word <> ''"), "s", "w")


def segments_json(files: DataFrame) -> DataFrame:
    """Segment-level transcripts, under either case of their keys; a segment's time is spread evenly over its words."""
    parsed = files.select("file_id", F.posexplode(F.from_json("json", SEGMENTS)).alias("s", "seg"))
    named = parsed.select("file_id", "s", _either("seg", "Content", "text").alias("text"), _either("seg", "Start", "start").cast("double").alias("from"), _either("seg", "End", "end").cast("double").alias("to"))
    words = named.withColumn("words", F.array_remove(F.split(F.trim("text"), r"\s+"), "")).withColumn("step", (F.col("to") - F.col("from")) / F.size("words"))
    each = words.filter("size(words) > 0").select("file_id", "s", "from", "step", F.posexplode("words").alias("w", "word"))
    rows = each.select("file_id", "s", "w", "word", (F.col("from") + F.col("w") * F.col("step")).alias("start"), (F.col("from") + (F.col("w") + 1) * F.col("step")).alias("end"), F.lit(1.0).alias("conf"))
    return _numbered(rows, "s", "w")


def chunks_json(files: DataFrame) -> DataFrame:
    """Chunk transcripts: each chunk one token; a missing start is 0, a missing end the start."""
    parsed = files.select("file_id", F.posexplode(F.from_json("json", CHUNKS)["chunks"]).alias("w", "x"))
    start = F.coalesce(F.get("x.timestamp", F.lit(0)), F.lit(0.0))
    rows = parsed.select("file_id", "w", F.trim("x.text").alias("word"), start.alias("start"), F.coalesce(F.get("x.timestamp", F.lit(1)), start).alias("end"), F.lit(1.0).alias("conf"))
    return _numbered(rows.filter("word <> ''"), "w")


def detect(files: DataFrame) -> DataFrame:
    """Adds shape: words, segments, chunks; a file of no known shape fails the query."""
    shape = (
        F.when(F.get_json_object("json", "$.segments").isNotNull(), "words")
        .when(F.get_json_object("json", "$.chunks").isNotNull(), "chunks")
        .when(F.get_json_object("json", "$[0]").isNotNull(), "segments")
        .otherwise(F.raise_error(F.concat(F.lit("no known transcript shape: "), "file_id")))
    )
    return files.withColumn("shape", shape)


def any_json(files: DataFrame) -> DataFrame:
    """Transcripts of all shapes, told apart by their keys."""
    shaped = detect(files)
    of = lambda name: shaped.filter(F.col("shape") == name).drop("shape")
    return words_json(of("words")).unionByName(segments_json(of("segments"))).unionByName(chunks_json(of("chunks")))


def chunk_rows(files: DataFrame, strict: bool = False) -> DataFrame:
    """(file_id, chunk, speaker, text, start, end) of segment-level transcripts, not split into words; strict: a chunk that lacks a field stops the query."""
    parsed = files.select("file_id", F.posexplode(F.from_json("json", SEGMENTS)).alias("chunk", "seg"))
    found = parsed.select("file_id", "chunk", _either("seg", "Speaker", "speaker").cast("int").alias("speaker"), _either("seg", "Content", "text").alias("text"), _either("seg", "Start", "start").cast("double").alias("start"), _either("seg", "End", "end").cast("double").alias("end"))
    if not strict:
        return found
    lacks = F.concat(F.lit("a chunk lacks a field: "), F.col("file_id"), F.lit(" "), F.col("chunk").cast("string"))
    return found.withColumn("text", F.when(F.col("text").isNull() | F.col("start").isNull() | F.col("end").isNull(), F.raise_error(lacks)).otherwise(F.col("text")))
