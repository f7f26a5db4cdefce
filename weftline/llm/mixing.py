"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources in code point order, null last, weigh 1, 2, 3 and so on in
turn and share all words; a target stops at MOST_COPIES times its source's
size, and the excess goes to the others by weight until none is above. A
source whose target is c times its size takes each document floor(c) times,
and once more with the fraction of c.

The fractions become whole by pivotal rounding over a reduction tree. In a
block of a source's documents, largest first, two documents that are still
fractional meet. Let `gain` be the words that the second can give to the first
before one of both is whole, and `loss` those that the first can give to the
second: the first gains with a chance of loss / (gain + loss), else it loses.
So the pair's words stay what they were, and each document's expected copies
are its fraction. At most one document a block stays fractional; those of BLOCK
blocks meet in a block of the next level, until one is left for each source,
which goes up with a chance equal to its fraction. Only that last one, a small
one, moves the source's total. Each step draws from a hash of both rows, which
orders nothing, so reruns agree.

Edge cases: a null or empty text has size 0, takes 0 words and no copies;
rows that are equal in every column are one unit and get equal copies; a null
source is a source of its own; very long texts count whole; an empty table
gives an empty result; other columns of the input, whatever their names and
types, come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.batches import fresh
from weftline.llm.scratch import Scratch

MOST_COPIES = 3
BLOCK = 128
WHOLE = 1e-9
_MASK = (1 << 64) - 1
_UNIT = "k long, skey string, size double, p double"


def words(text: str) -> F.Column:
    """The number of words of the whitespace kind; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(scratch: Scratch, sizes: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """skey, n, source_size, target of each source of sizes(skey, source, size)."""
    by = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    placed = scratch.ranked("sources", by, "place", F.col("source").asc_nulls_last())
    weighed = placed.withColumn("weight", (1 + F.col("place") % 3).cast("double"))
    total, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, before = (total or 0) / (weight or 1), -1
    top = most * F.col("source_size")
    while total:
        full = F.lit(level) * F.col("weight") > top
        taken, rest, count = weighed.agg(F.sum(F.when(full, top)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if count == before or not rest:
            break
        level, before = (total - (taken or 0)) / rest, count
    return weighed.select("skey", "n", "source_size", F.least(F.lit(float(level)) * F.col("weight"), top.cast("double")).alias("target"))


def chance(one: int, other: int) -> float:
    """A number in [0, 1) that two row keys fix."""
    x = (one * 0x9E3779B97F4A7C15 ^ other * 0xC2B2AE3D27D4EB4F) & _MASK
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> 30)) * factor & _MASK
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def meet(s1: float, p1: float, s2: float, p2: float, u: float) -> tuple[float, float]:
    """The fractions of two units after one pivotal step; at least one of them is 0 or 1."""
    gain, loss = min((1 - p1) * s1, p2 * s2), min(p1 * s1, (1 - p2) * s2)
    moved = gain if u * (gain + loss) < loss else -loss
    return p1 + moved / s1, p2 - moved / s2


def _round(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Pivotal rounding within each run of equal (skey, block); rows come sorted.

    Yields k, extra (0 or 1) of decided units and p, undecided, of the one left.
    """
    out: list[tuple] = []
    block = carry = None

    def leave() -> None:
        if carry is not None:
            k, size, p, skey = carry
            out.append((k, int(chance(k, 0) < p), skey, size, None) if last else (k, None, skey, size, p))

    def flush() -> pa.RecordBatch:
        k, extra, skey, size, p = (list(x) for x in zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(skey, pa.string()), pa.array(size, pa.float64()), pa.array(p, pa.float64()), pa.array(extra, pa.int32())], names=["k", "skey", "size", "p", "extra"])

    for batch in batches:
        for k, skey, size, p, at in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k", "skey", "size", "p", "block")), strict=True):
            if (skey, at) != block:
                leave()
                block, carry = (skey, at), None
            if carry is None:
                carry = (k, size, p, skey)
                continue
            mine, other = meet(carry[1], carry[2], size, p, chance(carry[0], k))
            left = None
            for unit, fraction in ((carry, mine), ((k, size, p, skey), other)):
                if min(fraction, 1 - fraction) <= WHOLE:
                    out.append((unit[0], round(fraction), skey, unit[1], None))
                else:
                    left = (unit[0], unit[1], fraction, skey)
            carry = left
        if len(out) > 50_000:
            yield flush()
    leave()
    if out:
        yield flush()


def copies(docs: DataFrame, source: str = "source", text: str = "text", most: float = MOST_COPIES) -> tuple[DataFrame, DataFrame]:
    """(units, sources): copies of each unit by its key k, and targets of each source.

    k is the hash of the whole row, see row_key(); units has k, copies.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(row_key(docs).alias("k"), F.col(source).cast("string").alias("source"), words(text).alias("size"))
    rows = rows.withColumn("skey", source_key("source"))
    rows = scratch.write("rows", rows)
    sources = targets(scratch, rows, most)
    sources = scratch.write("targets", sources)
    unit = rows.groupBy("k", "skey").agg(F.sum("size").cast("double").alias("size"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    unit = unit.join(sources, "skey").withColumn("share", share).withColumn("base", F.floor("share").cast("int"))
    unit = unit.withColumn("p", F.col("share") - F.col("base"))
    whole = (F.col("size") == 0) | (F.least("p", 1 - F.col("p")) <= WHOLE)
    base = scratch.write("units", unit.select("k", "skey", "size", "n", F.when(F.col("size") == 0, 0).otherwise(F.col("base") + F.when(whole & (F.col("p") > 0.5), 1).otherwise(0)).alias("base"), F.when(~whole, F.col("p")).alias("p")))
    widest = rows.groupBy("skey").count().agg(F.max("count")).first()[0] or 0
    open_units, blocks, done, level = base.filter("p is not null").select("k", "skey", "size", "p", "n"), widest, None, 0
    while True:
        blocks = -(-blocks // BLOCK)
        per_source = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(BLOCK ** (level + 1)))) if level == 0 else F.lit(blocks)
        dealt = open_units.withColumn("block", F.pmod(F.xxhash64("k", F.lit(level)), per_source)).select("k", "skey", "size", "p", "block")
        ordered = dealt.repartition("skey", "block").sortWithinPartitions("skey", "block", F.desc("size"), "k")
        last = blocks <= 1
        rounded = scratch.write(f"level{level}", ordered.mapInArrow(lambda b, last=last: _round(b, last), f"{_UNIT}, extra int"))
        settled = rounded.filter("extra is not null").select("k", "extra")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        open_units, level = rounded.filter("extra is null").select("k", "skey", "size", "p"), level + 1
    units = base.join(done, "k", "left").select("k", (F.col("base") + F.coalesce("extra", F.lit(0))).alias("copies"))
    units = scratch.write("copies", units, heavy=True)
    scratch.drop_all_but("copies", "targets")
    return units, sources


def row_key(docs: DataFrame) -> F.Column:
    """A hash of all columns of a row; nulls are told apart from empty values."""
    values = [F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return F.xxhash64(*values, F.to_json(F.struct(*[F.isnull(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])))


def source_key(source: str) -> F.Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def mix(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """The documents in as many copies as the mix takes of each; columns as before."""
    units, _ = copies(docs, source, text)
    k, n = fresh(docs, "weftline_row_key"), fresh(docs, "weftline_copies")
    taken = units.filter("copies > 0").select(F.col("k").alias(k), F.col("copies").alias(n))
    found = docs.withColumn(k, row_key(docs)).join(taken, k)
    return found.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[f"`{c}`" for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    units, sources = copies(docs)
    rows = docs.select("doc_id", row_key(docs).alias("k"), words("text").alias("size"), source_key("source").alias("skey"))
    found = rows.join(units, "k").join(sources.select("skey", "source_size", "target"), "skey")
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
