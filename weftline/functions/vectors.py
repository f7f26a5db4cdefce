"""Vector functions on arrays of floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def similar_pairs(vectors: DataFrame, label: str, key: str, vector: str, threshold: float, block: int = 1024) -> DataFrame:
    """(a, b, sim) of the vectors of one label, a < b, whose cosine similarity is over the threshold.

    Each label's vectors are dealt by hash to blocks of about `block` rows; two
    blocks are one matrix product, so a label of any size spreads over as many
    tasks as it has pairs of blocks, and only results become rows.
    """
    kind = dict(vectors.dtypes)[key]
    sizes = vectors.groupBy(label).agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = vectors.select(label, F.col(key).alias("key"), F.col(vector).alias("vector")).join(sizes, label).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    grouped = placed.groupBy(label, "block").agg(F.collect_list("key").alias("keys"), F.collect_list("vector").alias("vectors"))
    other = grouped.select(label, F.col("block").alias("block2"), F.col("keys").alias("keys2"), F.col("vectors").alias("vectors2"))

    def units(rows: object) -> np.ndarray:
        found = np.stack([np.asarray(v, float) for v in rows])
        with np.errstate(invalid="ignore", divide="ignore"):
            return found / np.linalg.norm(found, axis=1, keepdims=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                keys, keys2 = np.asarray(row.keys), np.asarray(row.keys2)
                sim = units(row.vectors) @ units(row.vectors2).T
                wanted = sim > threshold
                if row.block == row.block2:
                    wanted &= keys[:, None] < keys2[None, :]
                i, j = np.nonzero(wanted)
                swap = keys[i] > keys2[j]
                yield pd.DataFrame({"a": np.where(swap, keys2[j], keys[i]), "b": np.where(swap, keys[i], keys2[j]), "sim": sim[i, j]})

    met = grouped.join(other, label).filter("block <= block2").select("block", "keys", "vectors", "block2", "keys2", "vectors2")
    return met.mapInPandas(run, f"a {kind}, b {kind}, sim double")
