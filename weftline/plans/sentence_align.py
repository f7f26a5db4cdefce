"""Hypothesis words against reference sentences: aligned, timed, scored by sentence.

refs: (file_id, pos, word, sent_idx), hyps: (file_id, pos, word, start, end,
conf); positions count from 0 within a file. Files are aligned one by one in a
kernel; everything else is joins on positions and windows within a file.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from weftline.functions.text import normalization_type, normalize_word
from weftline.kernels import worddp
from weftline.plans import rowwise

#: Bytes of a curated list of phrases, which every task gets.
MOST_PHRASES = 64 << 20
_STEP = StructType([StructField(name, IntegerType()) for name in ("ref_from", "hyp_from", "ref_to", "hyp_to")])


def _sequence(rows: DataFrame, name: str) -> DataFrame:
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", normalize_word("word").alias("w")))), lambda x: x["w"])
    return rows.groupBy("file_id").agg(words.alias(name))


def _steps_of(ref: F.Column, hyp: F.Column, scores: worddp.Scores | None, whole_hyp: bool) -> F.Column:
    """(steps, status) of the words of a file."""
    scores = scores or worddp.Scores()

    def one(r: list[str] | None, h: list[str] | None) -> list[tuple]:
        return [] if r is None or h is None else [(s.ref_from, s.hyp_from, s.ref_to, s.hyp_to) for s in worddp.align(r, h, scores, whole_hyp)[0]]

    status = F.when(ref.isNull(), "no reference words").when(hyp.isNull(), "no hypothesis words").otherwise("ok")
    return F.struct(rowwise.listed(_STEP, one)(ref, hyp).alias("steps"), status.alias("status"))


def steps(refs: DataFrame, hyps: DataFrame, scores: worddp.Scores | None = None, whole_hyp: bool = True) -> DataFrame:
    """(file_id, step, ref_pos, hyp_pos, status) of each aligned pair.

    A file without words on one side gives one row that says so as its status.
    """
    aligned = _sequence(refs, "ref").join(_sequence(hyps, "hyp"), "file_id", "full").withColumn("found", _steps_of(F.col("ref"), F.col("hyp"), scores, whole_hyp))
    each = aligned.select("file_id", "found.status", F.posexplode_outer("found.steps").alias("step", "s"))
    consumed = lambda a, b: F.when(F.col(f"s.{b}") > F.col(f"s.{a}"), F.col(f"s.{b}") - 1)
    return each.select("file_id", "step", consumed("ref_from", "ref_to").alias("ref_pos"), consumed("hyp_from", "hyp_to").alias("hyp_pos"), "status")


def aligned_words(refs: DataFrame, hyps: DataFrame, scores: worddp.Scores | None = None, whole_hyp: bool = True) -> DataFrame:
    """(file_id, step, ref_pos, hyp_pos, status, ref_word, sent_idx, hyp_word, start, end, conf): steps with their words.

    Words travel with their file: one shuffle of each side, and no joins by position.
    """
    listed = lambda rows, *columns: rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("x"))
    left = listed(refs, "word", "sent_idx", normalize_word("word").alias("w")).withColumnRenamed("x", "r")
    right = listed(hyps, "word", "start", "end", "conf", normalize_word("word").alias("w")).withColumnRenamed("x", "h")
    met = left.join(right, "file_id", "full").withColumn("found", _steps_of(F.col("r.w"), F.col("h.w"), scores, whole_hyp))

    def row(s: F.Column) -> F.Column:
        r = F.when(s["ref_to"] > s["ref_from"], F.get("r", s["ref_from"]))
        h = F.when(s["hyp_to"] > s["hyp_from"], F.get("h", s["hyp_from"]))
        fields = [r["pos"].alias("ref_pos"), h["pos"].alias("hyp_pos"), r["word"].alias("ref_word"), r["sent_idx"].alias("sent_idx"), h["word"].alias("hyp_word"), *[h[c].alias(c) for c in ("start", "end", "conf")]]
        return F.struct(*fields)

    rows = met.select("file_id", "found.status", F.transform("found.steps", row).alias("rows"))
    each = rows.select("file_id", "status", F.posexplode_outer("rows").alias("step", "x"))
    return each.select("file_id", "step", "status", "x.*")


def edits(aligned: DataFrame, refs: DataFrame | None = None, hyps: DataFrame | None = None) -> DataFrame:
    """Steps with words, edit type, times and sentence; of steps() with both tables, or of aligned_words().

    Deletions last no time, at the end of the last word heard; a step belongs
    to the sentence of the last reference word consumed, at first to 0.
    """
    met = aligned.filter("status = 'ok' and step is not null")
    if refs is not None and hyps is not None:
        r = refs.select("file_id", F.col("pos").alias("ref_pos"), F.col("word").alias("ref_word"), "sent_idx")
        h = hyps.select("file_id", F.col("pos").alias("hyp_pos"), F.col("word").alias("hyp_word"), "start", "end", "conf")
        met = met.join(r, ["file_id", "ref_pos"], "left").join(h, ["file_id", "hyp_pos"], "left")
    by = Window.partitionBy("file_id").orderBy("step")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("start", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    clock = F.coalesce(F.last("end", ignorenulls=True).over(so_far), first)
    same = normalize_word("ref_word") == normalize_word("hyp_word")
    kind = F.when(F.col("ref_word").isNull(), "ins").when(F.col("hyp_word").isNull(), "del").when(same, "cor").otherwise("sub")
    return (
        met.withColumn("edit", kind)
        .withColumn("clock", clock)
        .withColumn("sent_idx", F.coalesce(F.last("sent_idx", ignorenulls=True).over(so_far), F.lit(0)))
        .withColumn("start", F.coalesce("start", "clock"))
        .withColumn("end", F.coalesce("end", "clock"))
        .withColumn("conf", F.coalesce("conf", F.lit(1.0)))
        .drop("clock", "status")
    )


def sentences(timed: DataFrame, refs: DataFrame) -> DataFrame:
    """(file_id, sent_idx, asr, start, end, score, ref_coverage, normalisations) of every reference sentence.

    score: correct steps of all steps, 0 for a sentence without any; reference
    words outside the aligned stretch are free, ref_coverage shows them.
    """
    ordered = lambda column, condition: F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("step", column)))), lambda x: x[column])
    new = F.when((F.col("edit") == "cor") & (F.col("ref_word") != F.col("hyp_word")), F.struct("ref_word", "hyp_word", normalization_type("ref_word", "hyp_word").alias("type")))
    heard = F.col("hyp_word").isNotNull()
    summary = timed.groupBy("file_id", "sent_idx").agg(
        F.array_join(ordered("hyp_word", heard), " ").alias("asr"),
        F.min(F.when(heard, F.col("start"))).alias("start"),
        F.max(F.when(heard, F.col("end"))).alias("end"),
        F.avg((F.col("edit") == "cor").cast("double")).alias("score"),
        F.count("ref_word").alias("covered"),
        F.array_sort(F.collect_set(new)).alias("normalisations"),
    )
    every = refs.groupBy("file_id", "sent_idx").agg(F.count("*").alias("n_ref"))
    met = every.join(summary, ["file_id", "sent_idx"], "left")
    return met.select("file_id", "sent_idx", F.coalesce("asr", F.lit("")).alias("asr"), "start", "end", F.coalesce("score", F.lit(0.0)).alias("score"), (F.coalesce("covered", F.lit(0)) / F.col("n_ref")).alias("ref_coverage"), "normalisations")


EPS = "<eps>"


def edit_kind(hyp: F.Column, ref: F.Column, duration: F.Column, oov: str | None = None, known: F.Column | None = None) -> F.Column:
    """cor, ins, del (no time), sil (no words, some time) or sub; an out-of-vocabulary mark against an unknown word is cor."""
    heard, written = hyp != EPS, ref != EPS
    kind = F.when((hyp == ref) & heard, "cor").when(heard & ~written, "ins").when(~heard & written & (duration == 0), "del")
    if oov is not None and known is not None:
        kind = kind.when((hyp == oov) & ~known, "cor")
    return kind.when(~heard & ~written & (duration > 0), "sil").otherwise("sub")


def timed_edits(aligned: DataFrame, refs: DataFrame, hyps: DataFrame, oov: str | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """(file_id, step, part, start, duration, hyp_word, conf, ref_word, edit) with silences of the hypothesis (word <eps>) kept.

    A silence against a reference word is two rows: the deletion, without time,
    and the silence with its time. vocabulary: (word) known to the recogniser.
    """
    r = refs.select("file_id", F.col("pos").alias("ref_pos"), F.col("word").alias("ref_word"))
    if vocabulary is not None:
        r = r.join(vocabulary.select(F.col("word").alias("ref_word"), F.lit(True).alias("in_vocabulary")).distinct(), "ref_word", "left")
    else:
        r = r.withColumn("in_vocabulary", F.lit(True))
    h = hyps.select("file_id", F.col("pos").alias("hyp_pos"), F.col("word").alias("hyp_word"), "start", (F.col("end") - F.col("start")).alias("duration"), "conf")
    met = aligned.filter("status = 'ok' and step is not null").join(r, ["file_id", "ref_pos"], "left").join(h, ["file_id", "hyp_pos"], "left")
    by = Window.partitionBy("file_id").orderBy("step")
    end = F.col("start") + F.col("duration")
    first = F.first("start", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    clock = F.coalesce(F.last(end, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)), first)
    hyp, ref = F.coalesce("hyp_word", F.lit(EPS)), F.coalesce("ref_word", F.lit(EPS))
    split = F.col("hyp_word").eqNullSafe(F.lit(EPS)) & (ref != EPS)
    unheard = F.col("hyp_word").isNull() | split
    same = lambda x: F.when(x.isin(EPS, oov or EPS), x).otherwise(normalize_word(x))
    kind = edit_kind(same(hyp), same(ref), F.col("duration"), oov, F.coalesce("in_vocabulary", F.lit(False)))
    row = lambda part, start, duration, h, c, r, e: F.struct(F.lit(part).alias("part"), start.alias("start"), duration.alias("duration"), h.alias("hyp_word"), c.alias("conf"), r.alias("ref_word"), e.alias("edit"))
    gone = row(0, F.col("clock"), F.lit(0.0), F.lit(EPS), F.lit(1.0), ref, F.lit("del"))
    real = row(0, F.col("start"), F.col("duration"), hyp, F.col("conf"), ref, kind)
    silence = row(1, F.col("start"), F.col("duration"), hyp, F.col("conf"), F.lit(EPS), F.lit("sil"))
    each = met.withColumn("clock", clock).withColumn("rows", F.when(split, F.array(gone, silence)).when(unheard, F.array(gone)).otherwise(F.array(real)))
    return each.select("file_id", "step", F.inline("rows"))


def with_known(found: DataFrame, known: DataFrame) -> DataFrame:
    """Sentences with their curated normalisations, and the newly detected ones apart as `new`.

    known: (ref, hyp, type). Pairs of type ASR-error are curated but not shown.
    """
    each = found.select("file_id", "sent_idx", F.explode("normalisations").alias("x")).select("file_id", "sent_idx", F.col("x.ref_word").alias("ref"), F.col("x.hyp_word").alias("hyp"), F.col("x.type").alias("detected"))
    met = each.join(known.select("ref", "hyp", "type").dropDuplicates(["ref", "hyp"]), ["ref", "hyp"], "left")
    listed = lambda kept: F.array_sort(F.collect_list(F.when(kept, F.struct("ref", "hyp", F.coalesce("type", "detected").alias("type")))))
    shown = met.groupBy("file_id", "sent_idx").agg(listed(F.col("type").isNotNull() & (F.col("type") != "ASR-error")).alias("normalisations"), listed(F.col("type").isNull()).alias("new"))
    return found.drop("normalisations").join(shown, ["file_id", "sent_idx"], "left")


def second_opinion(found: DataFrame, second: DataFrame, threshold: float = 1.0, validator: str | None = None) -> DataFrame:
    """Sentences with the words of the second hypothesis where it scores strictly higher, and who validated them.

    Both come from sentences(). Times stay those of the first hypothesis.
    """
    other = second.select("file_id", "sent_idx", F.col("asr").alias("asr2"), F.col("score").alias("score2"))
    met = found.join(other, ["file_id", "sent_idx"], "left")
    better = F.coalesce(F.col("score2") > F.col("score"), F.lit(False))
    valid = (F.col("score") == 1.0) | F.coalesce(F.col("score2") >= threshold, F.lit(False))
    met = met.withColumn("asr", F.when(better, F.col("asr2")).otherwise(F.col("asr"))).drop("asr2")
    return met if validator is None else met.withColumn("secondary_validation", F.when(valid, F.lit(validator)))


def align_files(refs: DataFrame, hyps: DataFrame, second: DataFrame | None = None, known: DataFrame | None = None, phrases: DataFrame | None = None, scores: worddp.Scores | None = None, whole_hyp: bool = True, strict: bool = True, **second_how: object) -> DataFrame:
    """Sentences (file_id, sent_idx, reference, asr, start, end, score, ...) from words, in one go.

    strict: a file without hypothesis words stops the query when its row is
    computed; else it stays, with its status, and its sentences score 0.
    """

    def one(words: DataFrame) -> tuple[DataFrame, DataFrame]:
        if phrases is not None:
            words = collapse_phrases(words, phrases).select("file_id", "pos", "word", "start", "end", "conf")
        aligned = aligned_words(refs, words, scores, whole_hyp)
        return aligned, sentences(edits(aligned), refs)

    aligned, found = one(hyps)
    status = aligned.groupBy("file_id").agg(F.first("status").alias("status"))
    if strict:
        status = status.withColumn("status", F.when(F.col("status") == "no hypothesis words", F.raise_error(F.concat(F.lit("no words in the hypothesis of "), F.col("file_id").cast("string")))).otherwise(F.col("status")))
    if second is not None:
        found = second_opinion(found, one(second)[1], **second_how)
    if known is not None:
        found = with_known(found, known)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    reference = refs.groupBy("file_id", "sent_idx").agg(text.alias("reference"))
    return found.join(reference, ["file_id", "sent_idx"]).join(status, "file_id", "left").filter("status is not null")


def collapse_phrases(hyps: DataFrame, phrases: DataFrame) -> DataFrame:
    """Hypothesis words with known phrases merged, greedily left to right, longest first.

    phrases: (ref, hyp) with hyp of two words or more. A merged word shows the
    words it came from, spans their time, and has their mean confidence.
    """
    listed = phrases.filter(F.size(F.split(F.trim("hyp"), r"\s+")) > 1).select("ref", "hyp")
    if (size := listed.agg(F.sum(F.octet_length("hyp") + F.octet_length("ref"))).first()[0] or 0) > MOST_PHRASES:
        raise ValueError(f"{size} bytes of phrases are more than a curated list")
    known = {tuple(r.hyp.split()): r.ref for r in listed.collect()}
    longest = max((len(k) for k in known), default=0)

    @F.pandas_udf("array<struct<first:int,last:int,ref:string>>")
    def run(words: pd.Series) -> pd.Series:
        def one(tokens: list[str]) -> list[dict]:
            out, at = [], 0
            while at < len(tokens):
                n = next((n for n in range(longest, 1, -1) if tuple(tokens[at : at + n]) in known and at + n <= len(tokens)), 1)
                out.append({"first": at, "last": at + n - 1, "ref": known.get(tuple(tokens[at : at + n])) if n > 1 else None})
                at += n
            return out

        return words.map(lambda w: one(list(w)))

    spans = _sequence(hyps, "words").select("file_id", F.posexplode(run("words")).alias("pos", "s")).select("file_id", "pos", "s.*")
    inside = spans.withColumn("old", F.explode(F.sequence("first", "last")))
    met = inside.join(hyps.withColumnRenamed("pos", "old"), ["file_id", "old"])
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("old", "word"))), lambda x: x["word"]), " ")
    return met.groupBy("file_id", "pos").agg(F.coalesce(F.first("ref"), shown).alias("word"), shown.alias("shown"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("conf").alias("conf"), F.first("ref").isNotNull().alias("fired"))
