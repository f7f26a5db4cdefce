"""Writers: edit lines, sentence records, rule exports, splits, annotations, new normalisations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import slug


def edit_lines(timed: DataFrame) -> DataFrame:
    """`id 1 start duration word confidence reference type` lines of timed edits."""
    word = lambda c: F.coalesce(c, F.lit("<eps>"))
    return timed.select(F.format_string("%s 1 %.3f %.3f %s %.2f %s %s", F.col("file_id").cast("string"), F.col("start"), F.col("end") - F.col("start"), word("hyp_word"), F.col("conf"), word("ref_word"), F.col("edit")).alias("value"))


def write_lines(lines: DataFrame, path: str, mode: str = "error") -> None:
    lines.write.mode(mode).text(path)


def write_records(rows: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; null fields are left out, other scripts stay readable."""
    rows.write.mode(mode).option("ignoreNullFields", "true").json(path)


def write_tsv(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).option("sep", "\t").option("header", "true").option("quote", "").csv(path)


def write_by(rows: DataFrame, path: str, key: str, value: str, mode: str = "error") -> None:
    """A folder of text lines for each value of a key: splits, chapters."""
    rows.select(key, F.col(value).alias("value")).write.mode(mode).partitionBy(key).text(path)


def new_normalisations(mined: DataFrame, known: DataFrame) -> DataFrame:
    """Mined pairs that are not known yet, case differences apart."""
    return mined.filter("type <> 'case'").select("ref", "hyp", "type").distinct().join(known.select("ref", "hyp"), ["ref", "hyp"], "left_anti")


def append_normalisations(mined: DataFrame, known: DataFrame, path: str) -> None:
    new_normalisations(mined, known).write.mode("append").option("sep", "\t").option("quote", "").csv(path)


def rule_export(rules: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key with its transforms, most frequent first, rates as percentages of two decimals."""
    entry = F.struct((-F.col("n")).alias("o"), F.col("target"), F.col("n").alias("count"), F.round(F.col("rate") * 100, 2).alias("rate"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("o"))
    return rules.groupBy(*keys).agg(F.max("total").alias("total"), ordered.alias("transforms"))


def save_annotations(rows: DataFrame, path: str) -> None:
    """Append a version of the annotations, stamped with its time."""
    rows.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def latest_annotations(saved: DataFrame) -> DataFrame:
    """The rows of the version saved last."""
    last = saved.agg(F.max("saved_at").alias("saved_at"))
    return saved.join(last, "saved_at")


def legacy_chunks(sentences: DataFrame) -> DataFrame:
    """(file_id, chunk_id, text, start, end, words): sentences under the names of the older chunk format."""
    return sentences.select("file_id", F.col("sent_idx").alias("chunk_id"), F.col("reference").alias("text"), "start", "end", "words")


def with_paths(config: DataFrame, produced: DataFrame, key: str = "chapter") -> DataFrame:
    """A configuration table with the paths that a step produced, (key, column, path), in place of its own."""
    names = [c for c in config.columns if c != key]
    wide = produced.groupBy(key).pivot("column", names).agg(F.max("path"))
    new = wide.select(key, *[F.col(c).alias(f"weftline_{c}") for c in names])
    return config.join(new, key, "left").select(*[F.coalesce(f"weftline_{c}", c).alias(c) if c in names else F.col(c) for c in config.columns])


def write_pages(pages: DataFrame, path: str, page: str = "page", overwrite: bool = False) -> None:
    """JSON lines in a folder for each page; without overwrite, pages that have one stay as they are."""
    spark = pages.sparkSession
    if overwrite:
        before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            pages.write.mode("overwrite").partitionBy(page).json(path)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        known = spark.read.json(path).select(F.col(page).cast("string").alias(page)).distinct()
        pages = pages.join(known, pages[page].cast("string") == known[page], "left_anti")
    pages.write.mode("append").partitionBy(page).json(path)


def write_chapters(texts: DataFrame, path: str, mode: str = "error") -> None:
    """A folder of text for each chapter (book, chapter, text), named by the chapter's label."""
    texts.select("book", slug("chapter").alias("name"), F.col("text").alias("value")).write.mode(mode).partitionBy("book", "name").text(path)


def edition_records(aligned: DataFrame, sentences: DataFrame, meta: dict[str, str] | None = None) -> DataFrame:
    """(a, b, meta, alignment): one record for each pair of editions, rows in order.

    aligned: (a, b, place, i, j), sentences: (edition, idx, sentence).
    """
    side = lambda e, k, name: sentences.select(F.col("edition").alias(e), F.col("idx").alias(k), F.col("sentence").alias(name))
    met = aligned.join(side("a", "i", "left"), ["a", "i"], "left").join(side("b", "j", "right"), ["b", "j"], "left")
    row = F.struct("place", F.struct(F.col("i").alias("index"), F.col("left").alias("sentence")).alias("edition_a"), F.struct(F.col("j").alias("index"), F.col("right").alias("sentence")).alias("edition_b"))
    listed = F.transform(F.array_sort(F.collect_list(row)), lambda x: x.dropFields("place"))
    pairs = F.create_map(*[F.lit(x) for kv in (meta or {}).items() for x in kv]) if meta else F.expr("cast(map() as map<string,string>)")
    return met.groupBy("a", "b").agg(listed.alias("alignment")).select("a", "b", pairs.alias("meta"), "alignment")


def ocr_records(words: DataFrame) -> DataFrame:
    """OCR alignments as records with box and confidence."""
    box = F.when(F.col("x1").isNotNull(), F.array("x1", "y1", "x2", "y2"))
    return words.select("doc", "pos", "word", "ref_word", F.round("confidence", 3).alias("confidence"), box.alias("bbox"), F.col("conf").alias("x_wconf"), "word_id", F.col("page").alias("page_num"))


def ocr_table(words: DataFrame) -> DataFrame:
    """(word, reference, confidence) of OCR alignments for a TSV, confidence with three decimals."""
    return words.select("doc", "pos", "word", F.coalesce("ref_word", F.lit("")).alias("reference"), F.format_string("%.3f", F.col("confidence")).alias("confidence"))


#: One utterance's alignment as it is saved.
ALIGNMENT = (
    "utterance_id string, audio_path string, ref_text string, sample_rate int, frame_shift_ms double, ref_phonemes array<string>, decoded_phonemes array<string>, "
    "segments array<struct<phoneme:string,ref_phoneme:string,start_frame:int,end_frame:int,start_time_s:double,end_time_s:double,variation_type:string,ref_state:int,lattice_score:double>>"
)


def write_alignments(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Alignments as JSON lines; fields without a value are written as null, so that they come back."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALIGNMENT).option("mode", "FAILFAST").json(path)


def write_corrected(transcripts: DataFrame, path: str, mode: str = "error") -> None:
    """Edited transcripts (file_id, ...) beside their source, in folders `<file_id>.corrected`."""
    transcripts.withColumn("weftline_name", F.concat("file_id", F.lit(".corrected"))).write.mode(mode).partitionBy("weftline_name").json(path)


def write_to_hub(rows: DataFrame, uri: str, mount: Callable[[str, str], str], kind: str = "parquet", mode: str = "error") -> str:
    """Write to an hf://owner/repo/path URI below the folder where `mount(owner, repo)` makes the repository available."""
    owner, repo, *rest = uri.removeprefix("hf://").split("/", 2)
    path = "/".join([mount(owner, repo).rstrip("/"), *rest])
    rows.write.format(kind).mode(mode).save(path)
    return path


#: What an operation may be classified as, by whether its words are equal.
EQUAL_CLASSES, OTHER_CLASSES, WITH_TEXT = ("reading", "normalisation"), ("asr", "reading", "normalisation", "punctuation", "dialect"), ("reading", "normalisation")


def checked_annotations(rows: DataFrame) -> DataFrame:
    """Annotations (op, classification, normalised, ...) whose classes are allowed; a wrong one stops the query. Only two classes carry a text."""
    allowed = F.when(F.col("op") == "equal", F.col("classification").isin(*EQUAL_CLASSES)).otherwise(F.col("classification").isin(*OTHER_CLASSES))
    wrong = F.raise_error(F.concat_ws(" ", F.lit("not a class of an operation"), "op", F.lit(":"), "classification"))
    kind = F.when(F.col("classification").isNull() | allowed, F.col("classification")).otherwise(wrong)
    text = F.when(F.col("classification").isin(*WITH_TEXT) & (F.trim("normalised") != ""), F.trim("normalised"))
    return rows.withColumn("classification", kind).withColumn("normalised", text)
