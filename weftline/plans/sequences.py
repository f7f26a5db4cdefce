"""Pipelines around the other kernels: pronunciations, editions, OCR, chunks, decoding."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from weftline.kernels import banddp, ctc, editdp, fuzzy, ocrseq, rewrite, tokendiff
from weftline.plans import rowwise

# The rows of the usual similarity matrix, in order.
SIMILARITY_SYMBOLS = "| OW UW EY AW AH AO AY EH K NG F JH M CH IH UH HH L AA R TH AE D Z OY DH IY B W S T SH ZH ER V Y N G P -".split()

# Types rather than DDL strings, so that the module can be imported without a session.
_OP = StructType([StructField("op", StringType()), StructField("ref_idx", IntegerType()), StructField("ref", StringType()), StructField("act", StringType())])
_READ = StructType([StructField("ref_pos", IntegerType()), StructField("confidence", DoubleType()), StructField("failed", BooleanType())])
_SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())])


def edit_ops(ref: F.Column | str, act: F.Column | str) -> F.Column:
    """Edit operations from one short sequence to another."""
    return rowwise.listed(_OP, lambda r, a: None if r is None or a is None else editdp.edits(r, a))(ref, act)


def operations(pairs: DataFrame, ref: str, act: str, keep: Sequence[str]) -> DataFrame:
    """(keep, idx, op, ref_idx, ref, act): one row for each operation."""
    each = pairs.select(*keep, F.posexplode(edit_ops(ref, act)).alias("idx", "o"))
    return each.select(*keep, "idx", "o.*")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def align_editions(vectors: DataFrame, edition: str, order: str, vector: str, pairs: DataFrame, compat: bool = False) -> DataFrame:
    """(a, b, place, i, j) of ordered texts, by cosine similarity; pairs: (a, b) of editions.

    Each pair is one task of the kernel, whose memory grows with the length of the texts.
    """
    lists = vectors.groupBy(F.col(edition).alias("e")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, vector))), lambda x: x[vector]).alias("v"))
    side = lambda name: lists.select(F.col("e").alias(name), F.col("v").alias(f"v{name}"))

    @F.pandas_udf("array<struct<i:int,j:int>>")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x: np.ndarray, y: np.ndarray) -> list[dict]:
            m, n = (np.stack([np.asarray(v, float) for v in side]) for side in (x, y))
            m, n = (k / np.maximum(np.linalg.norm(k, axis=1, keepdims=True), 1e-12) for k in (m, n))
            return [{"i": i, "j": j} for i, j in banddp.align_vectors(m, n, compat=compat)]

        return pd.Series([one(x, y) for x, y in zip(left, right, strict=True)])

    met = pairs.join(side("a"), "a").join(side("b"), "b").repartition(_tasks(vectors))  # few rows with much work each: dealt out one by one
    return met.select("a", "b", F.posexplode(run("va", "vb")).alias("place", "p")).select("a", "b", "place", "p.i", "p.j")


def align_ocr(ocr: DataFrame, reference: DataFrame, dictionary: frozenset[str] | DataFrame = frozenset()) -> DataFrame:
    """(doc, pos, word, ref_pos, ref_word, confidence, failed); ocr and reference: (doc, words); a dictionary of words, or a table (word).

    A table is joined, so that a task gets only the known words of its own documents.
    """
    met = ocr.join(reference.select("doc", F.col("words").alias("ref")), "doc")
    if isinstance(dictionary, DataFrame):
        used = ocr.select("doc", F.explode(F.array_distinct(F.transform("words", F.lower))).alias("word"))
        known = used.join(dictionary.select(F.lower("word").alias("word")).distinct(), "word").groupBy("doc").agg(F.collect_set("word").alias("known"))
        met, fixed = met.join(known, "doc", "left"), frozenset()
    else:
        met, fixed = met.withColumn("known", F.lit(None).cast("array<string>")), dictionary

    def one(w: list[str], r: list[str], listed: list[str] | None) -> list[tuple]:
        inside = fixed if listed is None else frozenset(listed)
        return ocrseq.align(w, r, lambda x: x.lower() in inside) if r else []

    found = met.withColumn("found", rowwise.listed(_READ, one)("words", "ref", "known"))
    each = found.select("doc", "words", "ref", F.posexplode("found").alias("pos", "f"))
    return each.select("doc", "pos", F.element_at("words", F.col("pos") + 1).alias("word"), "f.ref_pos", F.element_at("ref", F.col("f.ref_pos") + 1).alias("ref_word"), "f.confidence", "f.failed")


def chunk_ops(chunks: DataFrame, texts: DataFrame, compat: bool = False) -> DataFrame:
    """(doc, chunk, op, a0, a1, b0, b1): the diff of a text and its chunks, split at chunk bounds.

    chunks: (doc, chunk, words), texts: (doc, words).
    """
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "words")))
    grouped = chunks.groupBy("doc").agg(F.transform(ordered, lambda x: x["words"]).alias("chunks"))

    @F.pandas_udf("array<struct<chunk:int,op:string,a0:int,a1:int,b0:int,b1:int>>")
    def run(words: pd.Series, parts: pd.Series) -> pd.Series:
        def one(text: list[str], pieces: list[list[str]]) -> list[dict]:
            bounds = [0, *np.cumsum([len(p) for p in pieces]).tolist()]
            found = tokendiff.split(tokendiff.diff(text, [w for p in pieces for w in p]), bounds, compat)
            return [dict(zip(("chunk", "op", "a0", "a1", "b0", "b1"), f, strict=True)) for f in found]

        return pd.Series([one(list(w), [list(p) for p in c]) for w, c in zip(words, parts, strict=True)])

    return texts.join(grouped, "doc").select("doc", F.explode(run("words", "chunks")).alias("o")).select("doc", "o.*")


@F.pandas_udf(_SPAN)
def locate(short: pd.Series, long: pd.Series) -> pd.DataFrame:
    """Where a short text lies in a long one; null below the cutoff."""
    found = [fuzzy.locate(a, b) or (None, None, None) for a, b in zip(short, long, strict=True)]
    return pd.DataFrame(found, columns=["start", "end", "score"]).astype({"start": "Int32", "end": "Int32", "score": "float64"})


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Insert-delete similarity of two texts, 0 to 100."""
    return pd.Series([fuzzy.ratio(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StringType())
def line_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """A unified diff of two texts."""
    return pd.Series([tokendiff.text_diff(x, y) for x, y in zip(a, b, strict=True)])


def force_align(frames: DataFrame, tokens: DataFrame, blank: int = 0, shift: float = 0.02) -> DataFrame:
    """(utt_id, place, token, start, end, conf); frames: (utt_id, t, logits), tokens: (utt_id, tokens)."""
    posteriors = frames.groupBy("utt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "logits"))), lambda x: x["logits"]).alias("x"))

    @F.pandas_udf("array<struct<first:int,last:int,conf:double>>")
    def run(x: pd.Series, ids: pd.Series) -> pd.Series:
        def one(logits: np.ndarray, tok: np.ndarray) -> list[dict] | None:
            logp = ctc.log_softmax(np.stack([np.asarray(v, float) for v in logits]))
            return None if len(logp) < len(tok) else [{"first": a, "last": b, "conf": c} for a, b, c in ctc.forced(logp, [int(k) for k in tok], blank)]

        return pd.Series([one(a, b) for a, b in zip(x, ids, strict=True)])

    each = posteriors.join(tokens, "utt_id").select("utt_id", "tokens", F.posexplode(run("x", "tokens")).alias("place", "f"))
    seconds = lambda c: F.round(F.col(c) * shift, 3)
    return each.select("utt_id", "place", F.element_at("tokens", F.col("place") + 1).alias("token"), seconds("f.first").alias("start"), seconds("f.last").alias("end"), F.round("f.conf", 3).alias("conf"))


def decode(frames: DataFrame, arcs: DataFrame, symbols: dict[str, int], blank: int = 0) -> DataFrame:
    """(utt_id, place, t, label, state) of the best path through each utterance's arcs (utt_id, src, dst, label, weight).

    Arcs may have a column `candidate`: each candidate is a graph of its own, and the cheapest path of all counts, the first of equals.
    """
    if "candidate" not in arcs.columns:
        arcs = arcs.withColumn("candidate", F.lit(0))
    posteriors = frames.groupBy("utt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "logits"))), lambda x: x["logits"]).alias("x"))
    graphs = arcs.groupBy("utt_id", "candidate").agg(F.collect_list(F.struct("src", "dst", "label", "weight")).alias("arcs"))
    names = {v: k for k, v in symbols.items()}

    @F.pandas_udf("struct<cost:double,path:array<struct<t:int,label:string,state:int>>>")
    def run(x: pd.Series, graph: pd.Series) -> pd.DataFrame:
        def one(logits: np.ndarray, rows: list) -> tuple[float, list[dict]]:
            logp = ctc.log_softmax(np.stack([np.asarray(v, float) for v in logits]))
            table, markers = [], {}
            for a in rows:
                code = symbols.get(a["label"])
                if code is None:
                    code = -1 - markers.setdefault(a["label"], len(markers))
                table.append((a["src"], a["dst"], code, a["weight"]))
            back = {-1 - k: label for label, k in markers.items()}
            path, cost = ctc.best_path(logp, table, max(a["dst"] for a in rows), blank)
            return cost, [{"t": t, "label": back.get(s, names.get(s, "")), "state": state} for t, s, state in path]

        return pd.DataFrame([one(a, b) for a, b in zip(x, graph, strict=True)], columns=["cost", "path"])

    found = posteriors.join(graphs, "utt_id").select("utt_id", "candidate", run("x", "arcs").alias("r"))
    best = found.groupBy("utt_id").agg(F.min_by("r.path", F.struct("r.cost", "candidate")).alias("path"))
    return best.select("utt_id", F.posexplode("path").alias("place", "p")).select("utt_id", "place", "p.*")


def utterance_pronunciations(words: DataFrame, lexicon: DataFrame, rules: Sequence[rewrite.Rewrite] = (), most: int = rewrite.MOST_PATHS) -> DataFrame:
    """(utt, candidate, pron): all readings of utterances (utt, pos, word) by a lexicon (word, place, pron), each word's under the optional rules; the first is 0.

    Words without an entry drop out of the reading.
    """
    entries = lexicon.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pron"))), lambda x: x["pron"]).alias("prons"))
    met = words.join(entries, "word")
    grouped = met.groupBy("utt").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "prons"))), lambda x: x["prons"]).alias("words"))

    @F.pandas_udf("array<array<string>>")
    def run(utterances: pd.Series) -> pd.Series:
        def one(parts: list) -> list[list[str]]:
            readings = [list(dict.fromkeys(v for p in part for v in (rewrite.variants(list(p), rules) if rules else [tuple(p)]))) for part in parts]
            return [list(r) for r in rewrite.pronunciations(readings, most)]

        return pd.Series([one(u) for u in utterances])

    return grouped.select("utt", F.posexplode(run("words")).alias("candidate", "pron"))


def similarity_table(spark: SparkSession, matrix: np.ndarray | str, symbols: Sequence[str] | None = None) -> DataFrame:
    """(label, other, sim) of a square similarity matrix, or of the .npy file that holds it; symbols name its rows."""
    if isinstance(matrix, str):
        data = spark.read.format("binaryFile").load(matrix).select("content").first()[0]  # one small matrix
        matrix = np.load(io.BytesIO(bytes(data)))
    names = list(symbols or SIMILARITY_SYMBOLS)
    if matrix.shape != (len(names), len(names)):
        raise ValueError(f"a matrix of {matrix.shape} for {len(names)} symbols")
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(rows, "label string, other string, sim double")


def rewrite_variants(prons: DataFrame, rules: Sequence[rewrite.Rewrite]) -> DataFrame:
    """(word, variant, pron) of a lexicon (word, pron) after a cascade of optional rules."""

    @F.pandas_udf("array<array<string>>")
    def run(pron: pd.Series) -> pd.Series:
        return pd.Series([[list(v) for v in rewrite.variants(list(p), rules)] for p in pron])

    return prons.select("word", F.posexplode(run("pron")).alias("variant", "pron"))
