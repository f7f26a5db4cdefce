"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words. The patterns are windows of consecutive benchmark words,
grouped by their length. For each length a shift table, indexed by the hash of
a block of two words, says how far the search may jump when a block ends at a
position; only a shift of zero stops. There the suffix-hash bucket of the
block names the patterns that end in it, their first word is compared, then
all word hashes, then the bytes of the words.

Many stretches of text are searched in lockstep, so the jumps are numpy
gathers. The patterns are broadcast in parts of about PART_BYTES of benchmark
text, whose size is measured first; their tables take some 60 times that in each
Python worker. More than one part is searched
part by part, and the hits are merged by document.

Edge cases: a null or empty text has no words and no hits; a null benchmark
text or id gives no pattern; equal windows of several items count for each of
them; repeated rows each get their own equal result; an empty benchmark gives
zero hits everywhere, and an empty table an empty result; very long texts are
searched whole; columns of the input that have the name of a result are replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.batches import append_columns, without
from weftline.llm.kernels import ALNUM, LOWER, Prefix, Texts, U, mix, slices, word_counts
from weftline.llm.scratch import Scratch

WINDOW = 13
PART_BYTES = 4 << 20
#: Bits of the largest shift table, a byte for each slot.
MOST_BITS = 25
#: Window ends that one lane of the lockstep search covers.
LANE = 64
COLUMNS = "n_words long, hits array<struct<first:int,last:int>>, items array<string>"


@dataclass
class Length:
    """Tables of the patterns of one length.

    A pattern is a run of `size` of the benchmark's words, from word `first` on;
    hashes, starts and ends are those of all words, text is their bytes with one
    blank between, and items[bounds[k] : bounds[k + 1]] are the ids of pattern k's items.
    """

    size: int
    block: int
    bits: int
    shift: np.ndarray
    bucket_bits: int
    bucket: np.ndarray
    members: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: bytes
    bounds: np.ndarray
    items: list[str]

    def ids(self, k: int) -> list[str]:
        return self.items[self.bounds[k] : self.bounds[k + 1]]

    def bytes_of(self, k: int) -> bytes:
        return self.text[self.starts[self.first[k]] : self.ends[self.first[k] + self.size - 1]]

    def suffixes(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds among the members of the suffix-hash buckets of those slots."""
        slots = slots >> (self.bits - self.bucket_bits)
        return self.bucket[slots], self.bucket[slots + 1]


def _block_slots(hashes: np.ndarray, ends: np.ndarray, block: int, bits: int) -> np.ndarray:
    x = hashes[ends]
    if block == 2:
        x = x * U(0x9E3779B97F4A7C15) + hashes[ends - 1]
    return (mix(x) >> U(64 - bits)).astype(np.int64)


def _joined(part: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the words, lower-cased, each followed by a blank."""
    sizes = ends - starts
    nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    out[np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes) + nth] = LOWER[part.data[np.repeat(starts, sizes) + nth]]
    return out


def compile_patterns(items: list[tuple[str, str]], window: int = WINDOW) -> list[Length]:
    """Shift tables and suffix buckets of the windows of the items (id, text)."""
    hashes, sizes, texts, counts = [], [], [], []
    for part in slices(pa.array([t for _, t in items], pa.string())) if items else ():
        starts, ends, of = part.words(ALNUM)
        hashes.append(part.word_hashes(starts, ends, fold=True))
        sizes.append(ends - starts)
        texts.append(_joined(part, starts, ends))
        counts.append(word_counts(part, of))
    if not hashes or not sum(len(h) for h in hashes):
        return []
    hashes, sizes, text, count = (np.concatenate(x) for x in (hashes, sizes, texts, counts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    size = np.minimum(count, window)
    windows = np.where(count > 0, count - size + 1, 0)
    item = np.repeat(np.arange(len(items)), windows)
    first = np.repeat(np.cumsum(count) - count, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    names = [Prefix(hashes, which) for which in (0, 1)]
    out = []
    for n in np.unique(size[item]).tolist():
        at, whose = first[size[item] == n], item[size[item] == n]
        keys = np.stack([x.runs(at, at + n) for x in names], 1)
        _, chosen, which = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        at, pairs = at[chosen], np.unique(np.stack([which.ravel(), whose], 1), axis=0)
        block, bits = min(2, n), max(8, min(MOST_BITS, int(len(at) * n * 16).bit_length()))
        shift = np.full(1 << bits, n - block + 1, np.int8 if n < 128 else np.int32)
        for end in range(block - 1, n):
            slots = _block_slots(hashes, at + end, block, bits)
            np.minimum.at(shift, slots, n - 1 - end)
        order = np.argsort(slots, kind="stable")
        bucket_bits = min(bits, int(2 * len(at)).bit_length())
        bucket = np.searchsorted(slots[order] >> (bits - bucket_bits), np.arange((1 << bucket_bits) + 1)).astype(np.int32)
        bounds = np.searchsorted(pairs[:, 0], np.arange(len(at) + 1))
        out.append(Length(n, block, bits, shift, bucket_bits, bucket, order, at, hashes, starts, starts + sizes, text.tobytes(), bounds, [items[k][0] for k in pairs[:, 1].tolist()]))
    return out


def _candidates(p: Length, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Window ends at which the shift table stops the search, text by text."""
    first, last = bounds[:-1] + p.size - 1, bounds[1:]
    room = np.maximum(last - first, 0)
    lanes = -(-room // LANE)
    nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = np.repeat(first, lanes) + nth * LANE
    to = np.minimum(at + LANE, np.repeat(last, lanes))
    found = []
    while len(at):
        jump = p.shift[_block_slots(hashes, at, p.block, p.bits)]
        found.append(at[jump == 0])
        at = at + np.maximum(jump, 1)
        inside = at < to
        at, to = at[inside], to[inside]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def search(texts: Texts, lengths: list[Length]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """n_words of each text; of each occurrence its text, (first, last) word and items."""
    starts, ends, of = texts.words(ALNUM)
    counts = word_counts(texts, of)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    where, spans, items = [], [], []
    if len(starts) and lengths:
        hashes = texts.word_hashes(starts, ends, fold=True)
        folded = None
        for p in lengths:
            at = _candidates(p, hashes, bounds)
            if not len(at):
                continue
            low, high = p.suffixes(_block_slots(hashes, at, p.block, p.bits))
            found = high - low
            at = np.repeat(at, found)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(found) - found, found)
            which = p.members[np.repeat(low, found) + nth]
            for j in range(p.size):  # the first word prunes most, the rest follows
                same = hashes[at - p.size + 1 + j] == p.hashes[p.first[which] + j]
                at, which = at[same], which[same]
            if len(at) and folded is None:
                folded = LOWER[texts.data].tobytes()
            for end, w in zip(at.tolist(), which.tolist(), strict=True):
                lo = end - p.size + 1
                if b" ".join(folded[starts[j] : ends[j]] for j in range(lo, end + 1)) == p.bytes_of(w):
                    t = int(of[end])
                    where.append(t)
                    spans.append((lo - int(bounds[t]), end - int(bounds[t])))
                    items.append(p.ids(w))
    return counts, np.array(where, np.int64), np.array(spans, np.int64).reshape(-1, 2), items


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], last)
        else:
            out.append({"first": first, "last": last})
    return out


#: The tables of the part that this Python worker searched last, under the part's own token.
_compiled: dict[str, list[Length]] = {}


def _scan(docs: DataFrame, text: str, items: list[tuple[str, str]], window: int) -> DataFrame:
    sent, token = docs.sparkSession.sparkContext.broadcast(items), f"{uuid.uuid4().hex}-{window}"

    def kernel(rows: pa.RecordBatch, texts: Texts) -> dict:
        if token not in _compiled:
            _compiled.clear()
            _compiled[token] = compile_patterns(sent.value, window)
        counts, where, spans, found = search(texts, _compiled[token])
        hits: list[list] = [[] for _ in range(len(texts))]
        names: list[set] = [set() for _ in range(len(texts))]
        for t, span, ids in zip(where.tolist(), spans.tolist(), found, strict=True):
            hits[t].append(tuple(span))
            names[t].update(ids)
        return {"n_words": counts, "hits": [_merged(h) for h in hits], "items": [sorted(x) for x in names]}

    return append_columns(docs, text, kernel, COLUMNS)


def occurrences(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents with n_words, hits (merged word ranges inside occurrences) and items (ids that occur).

    Columns of these names in the input are replaced.
    """
    spark = docs.sparkSession
    wanted = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("t")).filter("id is not null and t is not null")
    size = wanted.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    parts = -(-size // part_bytes) or 1
    pick = lambda k: [(r.id, r.t) for r in wanted.filter(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == k).collect()]
    if parts == 1:
        return _scan(docs, text, pick(0), window)
    scratch, key = Scratch(spark), F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.xxhash64(F.to_json(key)).alias("row_key"), F.col(text).alias("t"))
    found = None
    for k in range(parts):
        one = scratch.write(f"part{k}", _scan(keyed.dropDuplicates(["row_key"]), "t", pick(k), window).drop("t"))
        found = one if found is None else found.unionByName(one)
    merge = F.expr(
        "aggregate(array_sort(flatten(collect_list(hits))), cast(array() as array<struct<first:int,last:int>>), (a, x) -> "
        "CASE WHEN size(a) > 0 AND x.first <= element_at(a, -1).last + 1 "
        "THEN concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last)))) "
        "ELSE concat(a, array(x)) END)"
    )
    found = found.groupBy("row_key").agg(F.max("n_words").alias("n_words"), merge.alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    left = without(docs, ["n_words", "hits", "items"]).withColumn("row_key", F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    return left.join(found, "row_key", "left").drop("row_key")


def verdicts(found: DataFrame) -> DataFrame:
    """Digest columns n_hit, n_items, items_sha256 and contaminated beside those of occurrences()."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1)
    return (
        without(found, ["n_hit", "n_items", "items_sha256", "contaminated"])
        .withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )
