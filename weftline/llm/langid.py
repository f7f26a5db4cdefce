"""Language identification: words first, then shorter and shorter character n-grams.

A known word scores by its log frequency in each language. A word that no
language has falls back to its character 4-grams, those unknown too to 3-, 2-
and 1-grams, each step at a penalty. A text takes the language with the
highest sum.

The model is learned from a bounded sample of labelled documents: about
SAMPLE_DOCS of each language, chosen by a hash of the id, of at most
SAMPLE_BYTES each. It has every word of the sample, so its size is bounded by
the sample's and it can be broadcast. Held-out documents (crc32 of the id as
text leaves remainder HELD_OUT modulo FOLDS) are never learned from.

Edge cases: a null text, or one without a letter, is `und` with score 0; null
languages are not learned; without any labelled document every text is `und`;
very long texts are scored whole; an empty table gives an empty result;
repeated rows get equal results; columns of the input that have the name of a
result are replaced.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.batches import append_columns
from weftline.llm.kernels import Texts
from weftline.llm.scratch import Scratch

FOLDS, HELD_OUT = 4, 2
SAMPLE_DOCS = 2000
SAMPLE_BYTES = 200_000
LONGEST = 4
#: Words whose n-grams are counted at once.
SLICE = 10_000
BACKOFF = math.log(0.4)
KEPT_WORDS = 1 << 16
UNKNOWN = "und"

#: What a word is, for Spark and for Python.
WORD = r"\p{L}+"
_WORD = regex.compile(WORD)


def held_out(doc_id: str) -> F.Column:
    """Whether a document belongs to the fold that is not learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], list[str], np.ndarray]:
    """(languages, words, counts of each word in each language), from the sample."""
    usable = docs.filter(~held_out(doc_id) & F.col(lang).isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES))
    sizes = {r[0]: r[1] for r in usable.groupBy(lang).count().orderBy(lang).collect()}
    if not sizes:
        return [], [], np.zeros((0, 0))
    chance = F.shiftrightunsigned(F.xxhash64(F.col(doc_id).cast("string"), F.lit("sample")), 11) / F.lit(float(1 << 53))
    share = F.lit(1.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, min(1.0, SAMPLE_DOCS / n)).otherwise(share)
    each = usable.filter(chance < share).select(F.col(lang).alias("l"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))).alias("w"))
    counts = each.groupBy("w", "l").count()
    counts = Scratch(docs.sparkSession).write("counts", counts)
    names = sorted(sizes)
    by = counts.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("l", "count"))).alias("by"))
    table = by.select("w", F.array(*[F.coalesce(F.col("by")[k], F.lit(0)) for k in names]).alias("n")).toArrow().combine_chunks()
    found = pc.list_flatten(table["n"]).to_numpy().reshape(-1, len(names))
    return names, table["w"].to_pylist(), found


class Model:
    """Log frequencies of words and of character n-grams for each language."""

    def __init__(self, names: list[str], words: list[str], counts: np.ndarray):
        self.names = names
        counts = counts.astype(float)
        self.index = {w: i for i, w in enumerate(words)}
        self.known = len(words)
        self.table = np.zeros((self.known + KEPT_WORDS, len(names)))
        self.table[: self.known] = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * max(len(words), 1)))
        self.grams: list[dict[str, int]] = [{}]
        self.gram_tables = [np.zeros((0, len(names)))]
        for size in range(1, LONGEST + 1):
            index: dict[str, int] = {}
            sums = np.zeros((0, len(names)))
            for first in range(0, len(words), SLICE):
                ids, owner = [], []
                for k in range(first, min(first + SLICE, len(words))):
                    grams = self.split(words[k], size)
                    ids += [index.setdefault(g, len(index)) for g in grams]
                    owner += [k] * len(grams)
                sums = np.concatenate([sums, np.zeros((len(index) - len(sums), len(names)))])
                np.add.at(sums, ids, counts[owner])
            self.grams.append(index)
            self.gram_tables.append(np.log((sums + 0.1) / (sums.sum(0) + 0.1 * max(len(index), 1))))

    def __getstate__(self) -> dict:
        """What is broadcast: the rows for unseen words are empty and stay behind."""
        return self.__dict__ | {"table": self.table[: self.known]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.table = np.concatenate([self.table, np.zeros((KEPT_WORDS, len(self.names)))])

    @staticmethod
    def split(word: str, size: int) -> list[str]:
        if size == 1:
            return list(word)
        word = f" {word} "
        return [word[i : i + size] for i in range(len(word) - size + 1)]

    def unseen(self, words: list[str]) -> np.ndarray:
        """For each word the mean log frequency of its longest n-grams that any language knows, at a penalty for each step down."""
        out, left = np.zeros((len(words), len(self.names))), range(len(words))
        for size in range(LONGEST, 0, -1):
            index, ids, sizes, done, rest = self.grams[size], [], [], [], []
            for k in left:
                found = [index[g] for g in self.split(words[k], size) if g in index]
                if found:
                    ids += found
                    sizes.append(len(found))
                    done.append(k)
                else:
                    rest.append(k)
            if done:
                starts = np.cumsum([0, *sizes[:-1]])
                out[done] = np.add.reduceat(self.gram_tables[size][ids], starts) / np.array(sizes)[:, None] + (LONGEST - size) * BACKOFF
            left = rest
        return out + BACKOFF

    def score(self, text: str) -> tuple[str, float]:
        """The best language and its share of the probability, by the mean score of a word."""
        words = _WORD.findall(text.lower())
        if not self.names or not words:
            return UNKNOWN, 0.0
        counts = Counter(words)
        new = [w for w in counts if w not in self.index]
        if len(self.index) + len(new) > len(self.table):  # forget the unseen words of earlier texts
            self.index = {w: i for w, i in self.index.items() if i < self.known}
            new = [w for w in counts if w not in self.index]
        total, room = np.zeros(len(self.names)), len(self.table) - len(self.index)
        values, at = self.unseen(new), len(self.index)
        self.table[at : at + min(room, len(new))] = values[:room]
        self.index.update((w, at + k) for k, w in enumerate(new[:room]))
        for word, value in zip(new[room:], values[room:], strict=True):
            total += counts.pop(word) * value
        ids = [self.index[w] for w in counts]
        return self._best(total + np.array(list(counts.values()), float) @ self.table[ids], len(words))

    def _best(self, total: np.ndarray, n: int) -> tuple[str, float]:
        share = np.exp((total - total.max()) / n)
        best = int(total.argmax())
        return self.names[best], float(share[best] / share.sum())


_models: dict[str, Model] = {}


def predict(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], text: str = "text") -> DataFrame:
    """The documents with lang_pred and score."""
    sent, token = docs.sparkSession.sparkContext.broadcast(Model(*model)), uuid.uuid4().hex

    def kernel(rows: pa.RecordBatch, texts: Texts) -> dict:
        if token not in _models:
            _models.clear()
            _models[token] = sent.value
        found = [_models[token].score(texts.bytes_of(t).decode("utf-8", "replace")) for t in range(len(texts))]
        return {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return append_columns(docs, text, kernel, "lang_pred string, score double")
