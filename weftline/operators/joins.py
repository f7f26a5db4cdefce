"""Joins of ordered data: containment, attribution, windowed nearest match, annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.islands import global_index


def with_rejects(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(joined rows, left rows without a partner)."""
    return left.join(right, list(on)), left.join(right, list(on), "left_anti")


def contained(outer: DataFrame, inner: DataFrame, keys: Sequence[str], width: float | None = None) -> DataFrame:
    """Each outer interval (start, end) with the inner ones (i_start, i_end) inside it; outer ones without any stay.

    With `width`, a bound on the length of outer intervals, time is cut into
    cells of that width and the join becomes an equi-join on (keys, cell).
    """
    if width is None:
        on = [F.col(f"o.{k}") == F.col(f"i.{k}") for k in keys]
        on += [F.col("i.i_start") >= F.col("o.start"), F.col("i.i_end") <= F.col("o.end")]
        condition = on[0]
        for c in on[1:]:
            condition = condition & c
        met = outer.alias("o").join(inner.alias("i"), condition, "left")
        return met.select("o.*", *[f"i.{c}" for c in inner.columns if c not in keys])
    cell = lambda x: F.floor(x / width)
    cells = outer.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    placed = inner.withColumn("cell", cell(F.col("i_start")))
    inside = cells.join(placed, [*keys, "cell"]).filter((F.col("i_start") >= F.col("start")) & (F.col("i_end") <= F.col("end"))).drop("cell")
    return outer.join(inside.select(*outer.columns, *[c for c in inner.columns if c not in keys]), outer.columns, "left")


def nearest_in_window(words: DataFrame, reference: DataFrame, keys: Sequence[str], ahead: int = 20, back: int = 20, edits: int = 0) -> DataFrame:
    """Each word (keys, pos, word) with the reference position (ref_pos, ref_word) it meets.

    First the nearest equal word from its position on, then the nearest before
    it; with edits, the smallest distance decides first.
    """
    near = (F.col("ref_pos") >= F.col("pos") - back) & (F.col("ref_pos") < F.col("pos") + ahead)
    width = max(ahead, back, 1)
    cell = lambda x: F.floor(x / width)
    cells = words.withColumn("weftline_cell", F.explode(F.sequence(cell(F.col("pos") - back), cell(F.col("pos") + ahead - 1))))  # three at most
    met = cells.join(reference.withColumn("weftline_cell", cell(F.col("ref_pos"))), [*keys, "weftline_cell"]).filter(near)
    distance = F.levenshtein(F.lower("word"), F.lower("ref_word"), edits) if edits else F.when(F.lower("word") == F.lower("ref_word"), 0).otherwise(-1)
    rank = F.struct(F.col("distance"), (F.col("ref_pos") < F.col("pos")).cast("int"), F.abs(F.col("ref_pos") - F.col("pos")))
    best = met.withColumn("distance", distance).filter("distance >= 0").groupBy(*keys, "pos").agg(F.min_by(F.struct("ref_pos", "ref_word", "distance"), rank).alias("b"))
    return words.join(best, [*keys, "pos"], "left").select(*words.columns, "b.ref_pos", "b.ref_word", "b.distance")


def prefer_better(primary: DataFrame, secondary: DataFrame, on: Sequence[str]) -> DataFrame:
    """Words of the second hypothesis where its score is strictly higher; all else stays primary."""
    second = secondary.select(*on, F.col("words").alias("words2"), F.col("score").alias("score2"))
    met = primary.join(second, list(on), "left")
    return met.withColumn("words", F.when(F.col("score2") > F.col("score"), F.col("words2")).otherwise(F.col("words"))).drop("words2")


def validated(score: Column, second: Column, threshold: float = 1.0) -> Column:
    """Whether the first score is 1, or the second reaches the threshold."""
    return (score == 1.0) | F.coalesce(second >= threshold, F.lit(False))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; aggregated before the shuffle if the order is by columns."""
    if all(isinstance(o, str) for o in order):
        rest = [c for c in df.columns if c not in keys]
        first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("weftline_first"))
        return first.select(*[c if c in keys else F.col(f"weftline_first.{c}").alias(c) for c in df.columns])
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("weftline_place", F.row_number().over(by)).filter("weftline_place = 1").drop("weftline_place")


def last_wins(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """The values of the last row of each key."""
    return df.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])


def unseen(new: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among the known ones."""
    return new.join(known.select(*keys).distinct(), list(keys), "left_anti")


def propagate(annotations: DataFrame) -> DataFrame:
    """Copies a classification to other operations with the same pair of texts, boilerplate apart."""
    given = annotations.filter("classification is not null and not boilerplate").groupBy("vv_text", "et_text").agg(F.min_by("classification", F.struct("segment_index", "diff_op_index")).alias("spread"))
    met = annotations.join(given, ["vv_text", "et_text"], "left")
    return met.withColumn("classification", F.coalesce("classification", F.when(~F.col("boilerplate"), F.col("spread")))).drop("spread")


def reattach(operations: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved classifications on the first operation of the same content in a segment; the last saved one wins."""
    content = ["segment_index", "op", "vv_text", "et_text"]
    latest = last_wins(saved, content, "saved_at", ["classification"])
    place = F.row_number().over(Window.partitionBy(*content).orderBy("diff_op_index"))
    return operations.withColumn("place", place).join(latest, content, "left").withColumn("classification", F.when(F.col("place") == 1, F.col("classification"))).drop("place")


def regroup(rows: DataFrame, key: str, order: str, first: Sequence[str], flag: str) -> DataFrame:
    """One row for each key: the first row's metadata, OR of the flag, and a new index by sorted key."""
    grouped = rows.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in first], F.bool_or(flag).alias(flag))
    return global_index(grouped, key)


def interleave(left: DataFrame, right: DataFrame, time: str) -> DataFrame:
    """Both event lists in time order, events without a class dropped."""
    return left.unionByName(right, allowMissingColumns=True).filter("class is not null").orderBy(time)


def hash_split(df: DataFrame, key: str, seed: int = 42, train: float = 0.9, val: float = 0.05) -> DataFrame:
    """Adds split: exact shares int(n * train), int(n * val) and the rest, by rank of a seeded hash.

    Ranks come from 4096 hash buckets, their running sizes, and the place in the bucket, so no task sorts all rows.
    """
    hashed = df.withColumn("weftline_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("weftline_bucket", F.substring("weftline_hash", 1, 3))
    counts = hashed.groupBy("weftline_bucket").agg(F.count("*").alias("weftline_size"))  # 4096 rows at most
    before = F.sum("weftline_size").over(Window.orderBy("weftline_bucket")) - F.col("weftline_size")
    offsets = counts.select("weftline_bucket", before.alias("weftline_before"), F.sum("weftline_size").over(Window.partitionBy()).alias("weftline_n"))
    place = F.row_number().over(Window.partitionBy("weftline_bucket").orderBy("weftline_hash", key))
    ranked = hashed.withColumn("weftline_place", place).join(F.broadcast(offsets), "weftline_bucket")
    rank = F.col("weftline_before") + F.col("weftline_place")
    cut = lambda share: F.floor(F.col("weftline_n") * share)
    name = F.when(rank <= cut(train), "train").when(rank <= cut(train) + cut(val), "val").otherwise("test")
    return ranked.withColumn("split", name).select(*df.columns, "split")
