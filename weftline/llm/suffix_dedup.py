"""Suffix-array dedup over bytes: distributed prefix doubling.

Spark sorts positions by their first FIRST bytes and ranks them, then sorts
pairs of ranks at growing offsets (25 and 50 bytes) and ranks anew, until a
position's rank is unique, when it leaves, or the ranks reach past the threshold
of 100 bytes. Of equal ranks all but the earliest position repeat.

Ranking every position would shuffle some hundred times the input (by_ranks()
does that; the README has the figures). So positions are sampled first, and
only what the samples leave undecided is ranked (see repeats):

* suffixes at winnowed anchors, one in about 32, are sorted by 37 bytes; where
  one is unique, so are all windows that elect it;
* the same sort compares the spans of anchors, past 100 bytes both ways; of
  equal spans one goes on, the others are repeats;
* what is left is compared in blocks of 8 windows and then of 2, by the 93 and 99
  bytes that the windows of a block share, and by its whole span;
* the windows of blocks that are still neither unique nor equal, some thousandth
  of all, go through prefix doubling.

Since a window's anchor depends on the window's content alone, no repeat is lost.

A byte goes if a 100-byte string that covers it also starts earlier (smaller
doc_id, or same document and earlier start). Edge cases: null and empty texts,
and texts under 100 bytes, lose nothing; a null doc_id counts as the largest
id; rows that repeat a doc_id and text count as one place and both keep it;
very long texts are read whole; an empty table gives an empty result; columns of
the input that have the name of a result, or doc, th or ranges, are replaced.

"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.batches import map_texts
from weftline.llm.kernels import Prefix, Texts, signed
from weftline.llm.repeats import Rule, cut, keyed, later_windows, spread
from weftline.llm.scratch import Scratch

LENGTH = 100
GRAM = 37
FIRST = 25
STEPS = (8, 2)
RULE = Rule("bytes", LENGTH, GRAM, within=True, steps=STEPS, first=FIRST)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with n_units (bytes), removed (maximal byte runs) and kept (the bytes left)."""
    return cut(docs, RULE, doc_id, text)


def _positions(texts_of: DataFrame, size: int) -> DataFrame:
    """(doc, th, pos, one, other) of every position with `size` bytes after it; one names these bytes."""

    def kernel(rows: pa.RecordBatch, texts: Texts) -> dict:
        grams = Prefix(texts.byte_values()).grams(size)
        of = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
        at = np.flatnonzero(np.arange(len(grams)) + size <= texts.offsets[of[: len(grams)] + 1])
        text = of[at]
        return {"doc": spread(rows, "doc", text), "th": spread(rows, "th", text), "pos": (at - texts.offsets[text]).astype(np.int32), "one": signed(grams[at]), "other": np.zeros(len(at), np.int64)}

    return map_texts(texts_of, "text", kernel, "doc long, th long, pos int, one long, other long")


def by_ranks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, th, pos): starts of the windows that also start earlier, by prefix doubling over every position of the texts."""
    once = keyed(docs, doc_id, text).dropDuplicates(["doc", "th"])
    return later_windows(Scratch(docs.sparkSession), _positions(once, FIRST), RULE)


def digests(found: DataFrame) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
