"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents; the last returns the shard manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, mixing, near_dedup, quality, sharding
from weftline.llm.batches import plain
from weftline.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content."""
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    renamed, names, back = plain(docs)
    return quality.verdicts(quality.measure(renamed, weights, names["text"])).filter("kept").select(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark passage occurs."""
    renamed, names, back = plain(docs)
    found = decontaminate.occurrences(renamed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names["text"])
    return decontaminate.verdicts(found).filter("n_hit = 0").select(back)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix takes."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each document of the mix."""
    return sharding.manifest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("shards", shards),
]

#: SQL cannot express the trained chain or the random rounding; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(f"stage{k}", stage(spark, docs, sf_dir))
        if k:
            scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
