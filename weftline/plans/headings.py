"""Chapters of a book matched to its headings, in order, and its text cut there."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from weftline.functions import text as T

SAME_NUMBER, OTHER_NUMBER, CONTENTS = 0.35, -0.2, 0.05
THRESHOLD, NUMBERED_THRESHOLD = 0.72, 0.58


@F.pandas_udf(DoubleType())
def gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity by matching blocks, 0 to 1."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def candidates(links: DataFrame, headings: DataFrame) -> DataFrame:
    """(book, idx, text, number, source) of in-page links and headings, the first of equal (idx, text)."""
    usable = ~F.col("text").rlike(r"^\d+$|^\[\w+\]$") & (T.key_text("text") != "")
    toc = links.filter(usable).withColumn("source", F.lit("toc"))
    titles = headings.filter(~T.key_text("text").isin("contents", "index")).withColumn("source", F.lit("heading"))
    both = toc.unionByName(titles)
    first = both.groupBy("book", "idx", T.key_text("text").alias("key")).agg(F.max(F.struct((F.col("source") == "toc").alias("o"), "text", "source")).alias("x"))
    return first.select("book", "idx", "x.text", T.section_numbers(F.col("x.text"))["first"].alias("number"), "x.source")


def scores(chapters: DataFrame, found: DataFrame) -> DataFrame:
    """(book, chapter, idx, score) of every chapter and candidate of one book.

    chapters: (book, chapter, label, number). A label counts by its best variant.
    """
    each = chapters.withColumn("variant", F.explode(T.label_variants("label")))
    met = each.join(found.withColumnRenamed("number", "theirs"), "book")
    a, b = T.key_text("variant"), T.key_text("text")
    base = met.groupBy("book", "chapter", "number", "idx", "theirs", "source").agg(F.max(T.text_match_score(a, b, gestalt(a, b))).alias("base"))
    number = F.when(F.col("number") == F.col("theirs"), SAME_NUMBER).when(F.col("number") != F.col("theirs"), OTHER_NUMBER).otherwise(0.0)
    score = F.col("base") + number + F.when(F.col("source") == "toc", CONTENTS).otherwise(0.0)
    return base.select("book", "chapter", "number", "idx", score.alias("score"))


def choose(scored: DataFrame) -> DataFrame:
    """(book, chapter, idx): each chapter's best candidate after the one chosen before it, null below the threshold."""
    options = F.array_sort(F.collect_list(F.struct("idx", "score")))
    per = scored.groupBy("book", "chapter").agg(options.alias("o"), F.first("number").alias("number"))
    rows = F.array_sort(F.collect_list(F.struct("chapter", "o", "number")))

    @F.pandas_udf(ArrayType(IntegerType()))
    def greedy(books: pd.Series) -> pd.Series:
        def one(chapters: list) -> list[int | None]:
            at, out = -1, []
            for c in chapters:
                best = max((x for x in c["o"] if x["idx"] > at), key=lambda x: x["score"], default=None)
                good = best is not None and best["score"] >= (THRESHOLD if c["number"] is None or pd.isna(c["number"]) else NUMBERED_THRESHOLD)
                out.append(best["idx"] if good else None)
                at = best["idx"] if good else at
            return out

        return books.map(one)

    chosen = per.groupBy("book").agg(rows.alias("c")).withColumn("idx", greedy("c"))
    return chosen.select("book", F.explode(F.arrays_zip(F.col("c.chapter").alias("chapter"), F.col("idx"))).alias("x")).select("book", "x.chapter", "x.idx")


def cut(paragraphs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(book, chapter, text): paragraphs (book, idx, text) from a chapter's heading to the next one's."""
    marks = chosen.filter("idx is not null")
    met = paragraphs.join(marks, ["book", "idx"], "left")
    by = Window.partitionBy("book").orderBy("idx")
    filled = met.withColumn("chapter", F.last("chapter", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))).filter("chapter is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n\n")
    return filled.groupBy("book", "chapter").agg(joined.alias("text"))
