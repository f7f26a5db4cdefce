"""Substring dedup over words: seed and extend.

Seeds are winnowed anchors of 13-word windows. Documents are joined on them by
one range-partitioned sort (see repeats), each seed is extended both ways over
all windows that it owns, whole spans first and single windows where a span
is only partly shared, and the maximal runs of words inside repeats of at
least 13 words are removed.

A word goes if a window that covers it also starts in a document with a
smaller doc_id. Edge cases: null and empty texts, and texts of fewer than 13
words, lose nothing; a null doc_id counts as the largest id; rows that repeat
a doc_id never remove words of one another; repeats inside one document stay;
very long texts are read whole; an empty table gives an empty result; columns of
the input that have the name of a result, or doc, th or ranges, are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.repeats import Rule, cut

WINDOW = 13
GRAM = 4


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents with n_units (words), removed (maximal word runs) and kept (the words left, as bytes)."""
    return cut(docs, Rule("words", window, gram, within=False), doc_id, text)


def digests(found: DataFrame) -> DataFrame:
    """n_words, n_removed and kept_sha256 of each document."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return found.select("doc_id", F.col("n_units").alias("n_words"), n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
