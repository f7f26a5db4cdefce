"""Where callers put in parts of their own: sentence splitters, label mappings, row fields, aligners as table functions, counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from weftline.functions import text as T
from weftline.kernels import banddp, editdp, worddp

#: Sentence splitters by name: from a text column to an array of sentences.
SPLITTERS: dict[str, Callable[[Column], Column]] = {"punctuation": T.sentences}


def add_splitter(name: str, split: Callable[[Column], Column]) -> None:
    """Register a splitter; a model's own can be a pandas UDF from text to an array of texts."""
    SPLITTERS[name] = split


def split_sentences(texts: DataFrame, text: str, name: str = "punctuation") -> DataFrame:
    """The rows with sent_idx and sentence, by a registered splitter; empty sentences drop."""
    each = F.filter(F.transform(SPLITTERS[name](F.col(text)), F.trim), lambda s: s != "")
    return texts.select("*", F.posexplode(each).alias("sent_idx", "sentence"))


def mapped_labels(rows: DataFrame, label: str, mapping: DataFrame, unknown: str | None = None) -> DataFrame:
    """Labels in another notation by a table (label, other); those that it lacks keep theirs, or become `unknown`."""
    table = mapping.select(F.col("label").alias("weftline_label"), F.col("other").alias("weftline_other")).dropDuplicates(["weftline_label"])
    met = rows.join(table, F.col(label) == F.col("weftline_label"), "left")
    rest = F.col(label) if unknown is None else F.lit(unknown)
    return met.withColumn(label, F.coalesce("weftline_other", rest)).drop("weftline_label", "weftline_other")


def with_fields(rows: DataFrame, audio: Column | str = "audio_path", reference: Column | str = "ref_text", pronunciation: Column | None = None) -> DataFrame:
    """(utt_id, audio, reference, pron) of rows of any layout; each field is a column or an expression."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    pron = F.lit(None).cast("array<string>") if pronunciation is None else pronunciation
    return rows.select("utt_id", as_column(audio).alias("audio"), as_column(reference).alias("reference"), pron.alias("pron"))


@udtf(returnType="op string, ref_idx int, ref string, act string")
class EditOps:
    """Edit operations between two arrays of strings, as a table."""

    def eval(self, ref: list, act: list) -> Iterator[tuple]:
        yield from editdp.edits(list(ref or ()), list(act or ()))


@udtf(returnType="ref_from int, hyp_from int, ref_to int, hyp_to int")
class AlignWords:
    """Steps of the word alignment of two arrays of strings, as a table."""

    def eval(self, ref: list, hyp: list) -> Iterator[tuple]:
        for s in worddp.align(list(ref or ()), list(hyp or ()))[0]:
            yield s.ref_from, s.hyp_from, s.ref_to, s.hyp_to


@udtf(returnType="i int, j int")
class AlignBand:
    """Pairs of two ordered lists by a similarity matrix, an array of its rows, as a table."""

    def eval(self, sim: list) -> Iterator[tuple]:
        import numpy as np

        yield from banddp.align(np.asarray([list(r) for r in sim], float).reshape(len(sim), -1))


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL: edit_ops_table, align_words_table, align_band_table."""
    for name, function in (("edit_ops_table", EditOps), ("align_words_table", AlignWords), ("align_band_table", AlignBand)):
        spark.udtf.register(name, function)


def counted(rows: DataFrame, ok: Column, name: str = "weftline") -> tuple[DataFrame, Observation]:
    """The rows, and an observation that has succeeded and failed once they were computed; no pass of its own."""
    seen = Observation(name)
    return rows.observe(seen, F.count_if(ok).alias("succeeded"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed")), seen
