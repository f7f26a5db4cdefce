"""Exact repeats of at least a given length across a corpus, found from winnowed anchors.

A window is `length` consecutive units (words or bytes) of one text. Each
window elects one anchor, the least-hashed gram inside it, by its own content,
so equal windows elect the same anchor at the same offset and every window
belongs to exactly one anchor. That leaves a fraction of the positions to
shuffle, and none of the windows undecided:

1. Spark sorts the anchors by (gram, span) and position. The span is the
   anchor extended both ways over all the windows that it owns. Anchors whose
   gram is unique are done: none of their windows repeats.
2. Where a whole span equals an earlier one, all its windows are repeats. Of
   each distinct span only the earliest place is kept as its representative.
3. Representatives whose gram also starts other spans are extended piece by
   piece, in blocks of fewer windows and longer cores: Spark sorts their names,
   unique cores drop out, and whatever is not the earliest of its run is a repeat.
4. The single windows that are left are sorted by their 128-bit names, or, if
   the rule says so, ranked by prefix doubling.

The sorts are range partitioned with the position as last key, so a gram that
holds a third of all rows spreads over many tasks, and each task reads its
sorted rows batch by batch; what a partition cannot
settle alone is whether its first span goes on from the one before, so one or
two rows a partition are compared in a second step. No group is ever gathered
in one task, and no pairs of a group are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.batches import append_columns, map_texts, without
from weftline.llm.kernels import NON_SPACE, Prefix, Texts, U, covered, mix, signed, winnow
from weftline.llm.scratch import Scratch

LAST_ID = (1 << 63) - 1
PLACES = "a long, b long, doc long, lo int, th long, n int, off int"
PLACE_COLUMNS = ("doc", "lo", "th", "n", "off")
REMOVED, REPRESENTATIVE, OPEN, EDGE = 0, 1, 2, 3


@dataclass(frozen=True)
class Rule:
    """What repeats: unit, window length, gram length of anchors, and whether a text repeats itself.

    steps: how many windows of a representative are compared at once, round by round.
    first: the single windows that are left are ranked by prefix doubling from so many units on; 0: the last step is 1 and names them whole.
    """

    unit: str
    length: int
    gram: int
    within: bool
    steps: tuple[int, ...] = (1,)
    first: int = 0

    def units(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Values of the units, the bounds of the texts among them, and the word spans if units are words."""
        if self.unit == "bytes":
            return texts.byte_values(), texts.offsets, ()
        starts, ends, of = texts.words(NON_SPACE)
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        return texts.word_hashes(starts, ends, fold=False), bounds, (starts, ends)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc: the id, null as the largest; th: tells texts of equal ids apart; text."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))


def _ids(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def spread(rows: pa.RecordBatch, name: str, text: np.ndarray) -> np.ndarray:
    """A column's value for each of the texts named."""
    return _ids(rows, name)[text]


def anchors(texts_of: DataFrame, rule: Rule) -> DataFrame:
    """A row for each anchor: a names its gram, b its span; lo and n say which windows it owns."""

    def kernel(rows: pa.RecordBatch, texts: Texts) -> dict | None:
        values, bounds, _ = rule.units(texts)
        if len(values) < rule.length:
            return None
        of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        names = Prefix(values)
        grams = names.grams(rule.gram)
        valid = np.arange(len(values)) + rule.length <= bounds[of + 1]
        at, lo, n = winnow(grams, rule.length - rule.gram + 1, valid)
        span = names.runs(lo, lo + n - 1 + rule.length)
        text = of[lo]
        return {
            "a": signed(grams[at]),
            "b": signed(mix(span + (at - lo).astype(np.uint64) * U(0x9E3779B97F4A7C15))),
            "doc": _ids(rows, "doc")[text],
            "lo": (lo - bounds[text]).astype(np.int32),
            "th": _ids(rows, "th")[text],
            "n": n.astype(np.int32),
            "off": (at - lo).astype(np.int32),
        }

    return map_texts(texts_of, "text", kernel, PLACES)


def blocks(texts_of: DataFrame, rule: Rule, step: int) -> DataFrame:
    """A row for each block of up to `step` neighbouring windows of the column `ranges`.

    Blocks are aligned to the anchor, so equal windows are in equally placed
    blocks. a names the core that all windows of the full block share, b the
    span of those windows that the anchor owns. With a step of 1 both are names
    of the one window.
    """

    def kernel(rows: pa.RecordBatch, texts: Texts) -> dict | None:
        values, bounds, _ = rule.units(texts)
        of, lo, n, off = _ranges(rows)
        if not len(of):
            return None
        low, high = (off - n + 1) // step, off // step
        count = high - low + 1
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        text, off, n, lo, block = (np.repeat(x, count) for x in (of, off, n, lo, high))
        block = block - nth
        far, near = np.minimum(block * step + step - 1, off), np.maximum(block * step, off - n + 1)
        anchor = bounds[text] + lo + off
        first, core = anchor - far, anchor - block * step
        names = Prefix(values)
        if step == 1:
            a, b = names.runs(first, first + rule.length), Prefix(values, 1).runs(first, first + rule.length)
        else:
            a = mix(names.runs(core, core + rule.length - step + 1) + block.astype(np.uint64))
            b = mix(names.runs(first, first + far - near + rule.length) + far.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        return {
            "a": signed(a),
            "b": signed(b),
            "doc": _ids(rows, "doc")[text],
            "lo": (first - bounds[text]).astype(np.int32),
            "th": _ids(rows, "th")[text],
            "n": (far - near + 1).astype(np.int32),
            "off": far.astype(np.int32),
        }

    return map_texts(texts_of, "text", kernel, PLACES)


def _ranges(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of the list column `ranges`: text, first window, number of windows and offset to the anchor of each entry."""
    column = rows.column(rows.schema.get_field_index("ranges"))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    fields = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in column.flatten().flatten())
    return np.repeat(np.arange(len(rows)), sizes), *fields


@dataclass
class _Open:
    """Where a sorted partition stands after a batch: its last span, and how many spans and runs there were."""

    a: int
    b: int
    doc: int
    lo: int
    head: pa.RecordBatch
    spans: int
    runs: int
    in_run: int


#: Rows of an unfinished run that are held back; more of them go on as representatives, which costs but loses nothing.
HELD = 65536


def _settled(rows: pa.RecordBatch, keep: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """The kept rows with their kind; names stay only where they are needed."""
    hide = pa.array(kind < OPEN)
    out = rows.take(pa.array(keep))
    columns = [pc.if_else(hide, pa.scalar(None, pa.int64()), out.column(k)) for k in (0, 1)]
    columns += [out.column(out.schema.get_field_index(k)) for k in PLACE_COLUMNS] + [pa.array(kind.astype(np.int8))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", *PLACE_COLUMNS, "kind"])


def _settle(batches: Iterator[pa.RecordBatch], within: bool, representatives: bool) -> Iterator[pa.RecordBatch]:
    """Over one sorted partition, batch by batch: which rows are repeats, which are representatives of their spans.

    Whatever follows an equal span in the partition is a repeat. Only the first
    row (and its ties) of the partition's first span stays open. A run of one
    span is not compared further, unless it may go on in another partition; so
    the first rows of a run are held back until a second span follows or the run ends.
    """
    at: _Open | None = None
    held: list[pa.RecordBatch] = []

    def release() -> Iterator[pa.RecordBatch]:
        for rows in held:
            yield _settled(rows, np.arange(rows.num_rows), np.full(rows.num_rows, REPRESENTATIVE, np.int8))
        held.clear()

    for rows in batches:
        if not rows.num_rows:
            continue
        a, b, doc, lo = (rows.column(rows.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("a", "b", "doc", "lo"))
        new = np.append(at is None or a[0] != at.a, a[1:] != a[:-1])
        new_span = new | np.append(at is None or b[0] != at.b, b[1:] != b[:-1])
        heads, span, run = np.flatnonzero(new_span), np.cumsum(new_span), np.cumsum(new)  # 0: what is carried on
        before = at or _Open(0, 0, 0, 0, rows.slice(0, 1), 0, 0, 0)
        head_doc, head_lo = np.append(before.doc, doc[heads])[span], np.append(before.lo, lo[heads])[span]
        later = (doc > head_doc) | (within & (doc == head_doc) & (lo > head_lo))
        spans = np.bincount(run[heads], minlength=run[-1] + 1)
        spans[0] += before.in_run
        kind = np.full(len(a), -1, np.int8)
        if representatives:
            decided = (spans[run] > 1) | (before.runs + run == 1)  # or the partition's first run
            kind[decided] = REPRESENTATIVE
        kind[before.spans + span == 1] = OPEN
        kind[later] = REMOVED
        if held and spans[0] > 1:
            yield from release()
        elif run[-1]:
            held.clear()
        keep = np.flatnonzero(kind >= 0)
        if len(keep):
            yield _settled(rows, keep, kind[keep])
        if representatives:
            waiting = np.flatnonzero((run == run[-1]) & (kind < 0))
            if len(waiting):
                held.append(rows.take(pa.array(waiting)))
            if sum(h.num_rows for h in held) > HELD:
                yield from release()
                spans[run[-1]] += 1
        at = _Open(a[-1], b[-1], head_doc[-1], head_lo[-1], rows.slice(heads[-1], 1) if len(heads) else before.head, before.spans + int(span[-1]), before.runs + int(run[-1]), int(spans[run[-1]]))
    yield from release()
    if at is not None and at.spans > 1:  # tells the next partition where its first span started
        yield _settled(at.head, np.array([0]), np.array([EDGE], np.int8))


def sorted_runs(scratch: Scratch, name: str, places: DataFrame, within: bool, representatives: bool) -> DataFrame:
    """PLACE_COLUMNS and kind of the places that repeat an earlier one, and of representatives if wanted."""
    order = ["a", "b", "doc", "lo", "th"]
    ranked = places.repartitionByRange(*order).sortWithinPartitions(*order)
    settled = scratch.write(name, ranked.mapInArrow(lambda batches: _settle(batches, within, representatives), f"{PLACES}, kind byte"), heavy=True)
    place = F.struct("doc", "lo") if within else F.col("doc")
    edges = settled.filter(F.col("kind") >= OPEN).groupBy("a", "b").agg(F.min(place).alias("first"))
    rest = settled.filter(F.col("kind") == OPEN).join(edges, ["a", "b"]).withColumn("kind", F.when(place > F.col("first"), REMOVED).otherwise(REPRESENTATIVE).cast("byte"))
    columns = [*PLACE_COLUMNS, "kind"]
    found = settled.filter(F.col("kind") < OPEN).select(columns).unionByName(rest.select(columns))
    return found if representatives else found.filter(F.col("kind") == REMOVED)


def offsets(rule: Rule) -> list[tuple[int, int]]:
    """(reach, step) of each round of doubling: ranks of `reach` units are paired with those `step` units on."""
    out, reach = [], rule.first
    while reach < rule.length:
        out.append((reach, min(reach, rule.length - reach)))
        reach += out[-1][1]
    return out


def positions(texts_of: DataFrame, rule: Rule) -> DataFrame:
    """(doc, th, pos, one, other): the positions whose ranks the windows of `ranges` need; one names the rule's first units there."""

    def kernel(rows: pa.RecordBatch, texts: Texts) -> dict | None:
        values, bounds, _ = rule.units(texts)
        of, lo, n, _ = _ranges(rows)
        if not len(of):
            return None
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.unique(np.repeat(bounds[of] + lo, n) + nth)
        for _, step in reversed(offsets(rule)):
            starts = np.union1d(starts, starts + step)
        text = np.searchsorted(bounds, starts, side="right") - 1
        return {"doc": _ids(rows, "doc")[text], "th": _ids(rows, "th")[text], "pos": (starts - bounds[text]).astype(np.int32), "one": signed(Prefix(values).runs(starts, starts + rule.first)), "other": np.zeros(len(starts), np.int64)}

    return map_texts(texts_of, "text", kernel, "doc long, th long, pos int, one long, other long")


def later_windows(scratch: Scratch, pairs: DataFrame, rule: Rule) -> DataFrame:
    """(doc, th, pos): windows that also start earlier, by prefix doubling.

    pairs: (doc, th, pos, one, other), each position once. Each round sorts the pairs and ranks the
    positions by them; a position's next pair is its rank and that of the
    position as far behind as the ranks reach. Positions of a unique rank
    leave, and with them those that would pair with them.
    """
    rounds, turn = offsets(rule), 0
    while True:
        places = scratch.ranked(f"sorted{turn}", pairs, "place", "one", "other", "doc", "pos", "th")
        heads = places.groupBy("one", "other").agg(F.min("place").alias("rank"), F.min(F.struct("doc", "pos")).alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
        met = places.join(heads, ["one", "other"])
        if turn == len(rounds):
            late = scratch.write("late", met.filter(F.struct("doc", "pos") > F.col("head")).select("doc", "th", "pos"), heavy=True)
            scratch.drop(f"sorted{turn}", f"ranks{turn - 1}")
            return late
        ranks = scratch.write(f"ranks{turn}", met.select("doc", "th", "pos", "rank"), heavy=True)
        scratch.drop(f"sorted{turn}", *([f"ranks{turn - 1}"] if turn else []))
        behind = ranks.select("doc", "th", (F.col("pos") - rounds[turn][1]).alias("pos"), F.col("rank").alias("other"))
        pairs = ranks.withColumnRenamed("rank", "one").join(behind, ["doc", "th", "pos"])
        turn += 1


def _gathered(places: DataFrame) -> DataFrame:
    return places.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "n", "off")).alias("ranges"))


def repeated(docs: DataFrame, rule: Rule, doc_id: str, text: str) -> DataFrame:
    """(doc, th, ranges): the windows of each text that occur earlier, as (lo, n) runs of window starts."""
    scratch = Scratch(docs.sparkSession)
    texts = keyed(docs, doc_id, text)
    found = sorted_runs(scratch, "anchors", anchors(texts, rule), rule.within, True)
    places = found.filter(F.col("kind") == REMOVED)
    for step in rule.steps:
        open_spans = _gathered(found.filter(F.col("kind") == REPRESENTATIVE))
        found = sorted_runs(scratch, f"step{step}", blocks(texts.join(open_spans, ["doc", "th"]), rule, step), rule.within, step > 1)
        places = places.unionByName(found.filter(F.col("kind") == REMOVED))
    if rule.first:
        open_spans = _gathered(found.filter(F.col("kind") == REPRESENTATIVE))
        once = texts.join(open_spans, ["doc", "th"]).dropDuplicates(["doc", "th"])
        ranked = later_windows(scratch, positions(once, rule), rule)
        one = [F.lit(x).cast("int").alias(c) for c, x in (("n", 1), ("off", 0))]
        places = places.unionByName(ranked.select("doc", F.col("pos").alias("lo"), "th", *one, F.lit(REMOVED).cast("byte").alias("kind")))
    found = scratch.write("repeats", _gathered(places), heavy=True)
    scratch.drop_all_but("repeats")
    return found


def cut(docs: DataFrame, rule: Rule, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with n_units, removed (maximal runs of removed units) and kept (bytes of what is left).

    Kept words are joined by one space; kept bytes are concatenated. Columns of
    the input that are named so, or doc, th or ranges, are left out.
    """
    docs = without(docs, ["doc", "th", "ranges", "n_units", "removed", "kept"])
    ranges = repeated(docs, rule, doc_id, text)
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))
    with_ranges = docs.withColumn("doc", doc).withColumn("th", F.xxhash64(text)).join(ranges, ["doc", "th"], "left")

    def kernel(rows: pa.RecordBatch, texts: Texts) -> dict:
        _, bounds, spans = (None, texts.offsets, ()) if rule.unit == "bytes" else rule.units(texts)
        of, lo, n, _ = _ranges(rows)
        gone = covered(int(bounds[-1]), bounds[of] + lo, bounds[of] + lo + n - 1 + rule.length)
        touched = np.zeros(len(texts), bool)
        touched[of] = True
        removed, kept = [], []
        for t in range(len(texts)):
            whole = texts.bytes_of(t)
            if not touched[t]:
                removed.append([])
                kept.append(whole if rule.unit == "bytes" else b" ".join(whole.split()))
                continue
            mask = gone[bounds[t] : bounds[t + 1]]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            removed.append([{"first": int(x), "last": int(y) - 1} for x, y in edges.reshape(-1, 2)])
            if rule.unit == "bytes":
                kept.append(np.frombuffer(whole, np.uint8)[~mask].tobytes())
            else:
                words = whole.split()
                kept.append(b" ".join(words[i] for i in np.flatnonzero(~mask).tolist()))
        return {"n_units": np.diff(bounds), "removed": removed, "kept": kept}

    done = append_columns(with_ranges, text, kernel, "n_units long, removed array<struct<first:int,last:int>>, kept binary")
    return done.drop("doc", "th", "ranges")
