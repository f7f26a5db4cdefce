"""Line-based sources: reference texts, lexicons, dictionaries, intervals, labels, manifests, playlists."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import normalize_word
from weftline.sources.transcripts import file_stem


def lines(spark: SparkSession, path: str, recursive: bool = False, pattern: str = "*") -> DataFrame:
    """(file, line_no, line) of text files, in file order, with either kind of line end.

    Files are split like any text input. A line's number is the count of lines
    before it in its file, by the place of its block, so no file has to fit one task.
    """
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", r"\r$", "").alias("line"), F.monotonically_increasing_id().alias("at"))
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("file", "block", "first", before.alias("before"))
    met = rows.join(offsets, ["file", "block"])
    return met.select("file", (F.col("before") + F.col("at") - F.col("first")).cast("int").alias("line_no"), "line")


def _field(n: int, parts: Column) -> Column:
    return F.get(parts, F.lit(n))


def reference_tsv(rows: DataFrame) -> DataFrame:
    """(id, text) of `id<TAB>text` lines; the last line of an id wins."""
    parts = F.split("line", "\t", 2)
    return rows.filter(F.size(parts) == 2).groupBy(F.trim(_field(0, parts)).alias("id")).agg(F.max_by(F.trim(_field(1, parts)), "line_no").alias("text"))


def kaldi_text(rows: DataFrame) -> DataFrame:
    """(id, words) of `id w1 w2` lines with a word at least."""
    parts = F.split(F.trim("line"), r"\s+")
    return rows.filter(F.size(parts) >= 2).select(_field(0, parts).alias("id"), F.slice(parts, F.lit(2), F.size(parts) - 1).alias("words"))


def sentences_tsv(rows: DataFrame) -> DataFrame:
    """(id, sent_idx, sentence) of lines that repeat an id, in line order."""
    parts = F.split("line", "\t", 2)
    found = rows.filter(F.size(parts) == 2).select(F.trim(_field(0, parts)).alias("id"), "line_no", F.trim(_field(1, parts)).alias("sentence")).filter("sentence <> ''")
    return found.withColumn("sent_idx", F.row_number().over(Window.partitionBy("id").orderBy("line_no")) - 1).drop("line_no")


def numbered_tsv(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, number, sent_idx, sentence): one list of numbered sentences for every file of `files`."""
    parts = F.split("line", "\t", 2)
    found = rows.filter(F.size(parts) == 2).select("file", "line_no", _field(0, parts).alias("number"), _field(1, parts).alias("sentence"))
    listed = found.withColumn("sent_idx", F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1).drop("file", "line_no")
    return files.select("file_id").join(listed, F.lit(True))


def normalisations(spark: SparkSession, path: str) -> DataFrame:
    """(ref, hyp, type, key) of a curated list; a missing file is an empty list, a missing type is normalization.

    key: the normalised words of hyp.
    """
    schema = "ref string, hyp string, type string"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{schema}, key array<string>")
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    words = F.transform(F.filter(F.split(F.trim("hyp"), r"\s+"), lambda w: w != ""), normalize_word)
    return rows.filter("hyp is not null").withColumn("type", F.coalesce("type", F.lit("normalization"))).withColumn("key", words)


def interval_file(rows: DataFrame) -> DataFrame:
    """(file, start, end, label) of lines with exactly three fields."""
    parts = F.split(F.trim("line"), r"\s+")
    return rows.filter(F.size(parts) == 3).select("file", _field(0, parts).try_cast("int").alias("start"), _field(1, parts).try_cast("int").alias("end"), _field(2, parts).alias("label"))


def paired_intervals(words: DataFrame, phones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word and phone intervals with a common key: the path without its suffix."""
    key = F.lower(F.regexp_replace("file", r"\.[^./]*$", ""))
    return words.withColumn("key", key), phones.withColumn("key", key)


def interval_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Word and phone intervals of all .WRD and .PHN files below a folder, with their common key."""
    of = lambda suffix: interval_file(lines(spark, root, recursive=True, pattern=f"*.{{{suffix},{suffix.lower()}}}"))
    return paired_intervals(of("WRD"), of("PHN"))


def slash_dictionary(rows: DataFrame) -> DataFrame:
    """(word, pron) of `word /p1 p2/` lines; ; starts a comment, the last line of a word wins."""
    found = rows.filter(~F.col("line").startswith(";")).select("line_no", F.regexp_extract("line", r"^\s*(\S+)\s+/([^/]*)/", 1).alias("word"), F.regexp_extract("line", r"^\s*(\S+)\s+/([^/]*)/", 2).alias("p"))
    return found.filter("word <> ''").groupBy("word").agg(F.split(F.trim(F.max_by("p", "line_no")), r"\s+").alias("pron"))


def lexicon_tsv(rows: DataFrame) -> DataFrame:
    """(word, place, pron) of `word<TAB>p1 p2` lines, # comments; a word may have several, in line order."""
    parts = F.split(F.trim("line"), "\t", 2)
    found = rows.filter(~F.col("line").startswith("#") & (F.size(parts) == 2)).select(_field(0, parts).alias("word"), "line_no", F.split(F.trim(_field(1, parts)), r"\s+").alias("pron"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy("line_no")) - 1).drop("line_no")


def word_list(rows: DataFrame) -> DataFrame:
    return rows.select(F.lower(F.trim("line")).alias("word")).filter("word <> ''").distinct()


def label_file(rows: DataFrame) -> DataFrame:
    """(name, transcription, bad) of `file transcription` lines; bad: no transcription."""
    parts = F.split("line", " ", 2)
    return rows.filter("trim(line) <> ''").select(_field(0, parts).alias("name"), _field(1, parts).alias("transcription"), (F.size(parts) < 2).alias("bad"))


def manifest(rows: DataFrame) -> DataFrame:
    """(id, audio_path, ref_text, bad) of JSON lines; an id defaults to utt_<line>, broken lines are bad."""
    parsed = rows.filter("trim(line) <> ''").withColumn("j", F.from_json("line", "audio_path string, ref_text string, id string"))
    default = F.format_string("utt_%06d", F.col("line_no"))
    return parsed.select(F.coalesce("j.id", default).alias("id"), "j.audio_path", "j.ref_text", F.col("j.audio_path").isNull().alias("bad"))


def url_list(rows: DataFrame) -> DataFrame:
    """URLs, lines that start with # apart."""
    return rows.filter(~F.col("line").startswith("#")).select(F.trim("line").alias("url")).filter("url <> ''")


def lexicon_pronunciation(words: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first pronunciation of each word of (utt, pos, word), joined by utterance; words that have none)."""
    first = lexicon.filter("place = 0").select("word", "pron")
    met = words.join(first, "word")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "pron"))), lambda x: x["pron"])
    return met.groupBy("utt").agg(F.flatten(ordered).alias("pron")), words.join(first, "word", "left_anti").select("word").distinct()


def variants(rows: DataFrame, compat: bool = False) -> DataFrame:
    """(file, bandwidth, uri) of the best variant of a master playlist, the first of equals.

    compat: a BANDWIDTH that is the first attribute is overlooked and counts as 0.
    """
    by = Window.partitionBy("file").orderBy("line_no")
    trimmed = rows.withColumn("line", F.trim("line")).withColumn("uri", F.lead("line").over(by))
    pattern = r"(?i),BANDWIDTH=(\d+)" if compat else r"(?i)[:,]BANDWIDTH=(\d+)"
    bandwidth = F.coalesce(F.regexp_extract("line", pattern, 1).try_cast("long"), F.lit(0))
    streams = trimmed.filter(F.col("line").startswith("#EXT-X-STREAM-INF:") & ~F.col("uri").startswith("#") & (F.col("uri") != ""))
    return streams.groupBy("file").agg(F.max_by(F.struct(bandwidth.alias("bandwidth"), "uri"), F.struct(bandwidth, -F.col("line_no"))).alias("b")).select("file", "b.*")


def segments(rows: DataFrame, default: int = 2) -> DataFrame:
    """(file, place, uri, duration, poll_s) of a media playlist."""
    trimmed = rows.withColumn("line", F.trim("line"))
    target = trimmed.groupBy("file").agg(F.coalesce(F.max(F.regexp_extract("line", r"^#EXT-X-TARGETDURATION:(\d+)", 1).try_cast("int")), F.lit(default)).alias("duration"))
    uris = trimmed.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    placed = uris.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1)
    return placed.join(target, "file").select("file", "place", F.col("line").alias("uri"), "duration", F.greatest(F.lit(1), F.floor(F.col("duration") / 2)).cast("int").alias("poll_s"))


def book_config(spark: SparkSession, path: str, defaults: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chapters to do, chapters with missing inputs) of a book's YAML; a chapter's values come before the defaults."""
    import yaml

    config = yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    keys = ["chapter", "audio_file", "whisperx_json", "text_url", "text_file", "aligned_json"]
    rows = [tuple(str(v) if (v := c.get(k, (defaults or {}).get(k))) is not None else None for k in keys) for c in config.get("chapters", [])]
    chapters = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in keys))
    missing = F.coalesce(F.col("audio_file").contains("FILL_IN") | F.col("whisperx_json").contains("FILL_IN") | F.col("text_url").contains("FILL_IN"), F.lit(True))
    return chapters.filter(~missing), chapters.filter(missing)


def rewrite_rules(path: str) -> list:
    """Rewrite rules of a YAML file, in order; a rule without a segment is refused."""
    import yaml

    from weftline.kernels.rewrite import Rewrite

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    out = []
    for k, rule in enumerate(found.get("rules", [])):
        if not rule.get("segment"):
            raise ValueError(f"rule {k} has no segment")
        out.append(Rewrite(str(rule["segment"]), str(rule.get("replacement") or ""), str(rule.get("preceding_context") or ""), str(rule.get("following_context") or "")))
    return out


def hub_path(uri: Column) -> Column:
    """(owner, repo, path) of an hf:// URI."""
    parts = F.split(F.regexp_replace(uri, "^hf://", ""), "/", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("repo"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("path"))


def sourced(rows: DataFrame) -> DataFrame:
    """Adds file_id, the file's name without its suffix."""
    return rows.withColumn("file_id", file_stem(F.col("file")))
