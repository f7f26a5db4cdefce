"""Gaps and islands: merging neighbours, run-length encoding, forward fill, sequential ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, name: str = "island") -> DataFrame:
    """Adds the number of the island of each row; starts: true where a new one begins (null counts as true)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def merge_contiguous(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, text: str | None = None, first: Sequence[str] = (), gap: float = 1e-3, separator: str = " ") -> DataFrame:
    """Rows whose start is less than `gap` from the end of the row before become one.

    Texts are joined in order, columns in `first` keep the first row's value.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    apart = F.abs(F.col(start) - F.lag(end).over(by)) >= gap
    marked = number_islands(df, keys, order, F.coalesce(apart, F.lit(True)))
    place = F.struct(*[F.col(c) for c in order])
    out = [F.min_by(start, place).alias(start), F.max_by(end, place).alias(end), F.count("*").alias("n_rows")]
    if text:
        out.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), separator).alias(text))
    out += [F.min_by(c, place).alias(c) for c in first]
    return marked.groupBy(*keys, "island").agg(*out)


def run_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """(keys, run, label, first and last order value, length) of runs of equal labels."""
    by = Window.partitionBy(*keys).orderBy(*order)
    marked = number_islands(df, keys, order, ~F.col(label).eqNullSafe(F.lag(label).over(by)) | (F.row_number().over(by) == 1), "run")
    return marked.groupBy(*keys, "run").agg(F.first(label).alias(label), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length"))


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, default: Column | None = None) -> DataFrame:
    """The column's last value that is not null, up to each row."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(column, ignorenulls=True).over(by)
    return df.withColumn(column, filled if default is None else F.coalesce(filled, default))


def sequential(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, base: int = 0) -> DataFrame:
    """Gapless ids in an order, from `base`."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1 + base)


def bridge_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", min_length: int = 8, max_gap: int = 30) -> DataFrame:
    """Keeps intervals of at least min_length, then joins those at most max_gap apart."""
    kept = df.filter(F.col(end) - F.col(start) >= min_length)
    by = Window.partitionBy(*keys).orderBy(start)
    marked = number_islands(kept, keys, [start], F.col(start) - F.lag(end).over(by) > max_gap)
    return marked.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def longest_interval(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """The longest interval of each key, the first of equals."""
    best = F.max_by(F.struct(start, end), F.struct(F.col(end) - F.col(start), -F.col(start)))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{start}", f"b.{end}")


def global_index(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """Gapless ids over the whole table in the order of a key of any kind, without sorting it in one task.

    Rows are sorted by sampled ranges of the key and then of all columns, so a
    frequent key spreads over tasks; the sizes of the parts, one row each, give the offsets.
    """
    order = [key, *[c for c, kind in df.dtypes if c != key and "map<" not in kind]]
    ranked = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("weftline_at", F.monotonically_increasing_id())
    part = F.shiftright("weftline_at", 33)
    sizes = ranked.groupBy(part.alias("weftline_part")).agg(F.count("*").alias("weftline_size"))
    before = F.sum("weftline_size").over(Window.orderBy("weftline_part")) - F.col("weftline_size")
    offsets = F.broadcast(sizes.select("weftline_part", before.alias("weftline_before")))  # one row for each partition
    placed = ranked.join(offsets, part == F.col("weftline_part"))
    place = F.col("weftline_before") + F.col("weftline_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn(name, place.cast("long")).drop("weftline_at", "weftline_part", "weftline_before")
