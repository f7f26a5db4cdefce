"""Acoustic tables: vowel and band tracks of signals, fricative classes, segment summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.kernels import acoustics


def vowel_track(signals: DataFrame) -> DataFrame:
    """(utt_id, t, class, f1, f2, f3) of signals (utt_id, rate, samples)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, *r) for u, rate, y in zip(batch["utt_id"], batch["rate"], batch["samples"], strict=True) for r in acoustics.vowel_track(np.asarray(y, float), int(rate))]
            yield pd.DataFrame(rows, columns=["utt_id", "t", "class", "f1", "f2", "f3"])

    return signals.select("utt_id", "rate", "samples").mapInPandas(run, "utt_id string, t double, class string, f1 double, f2 double, f3 double")


def fricative_class(sh: Column, s: Column) -> Column:
    """S or SH where that band leads and is strong enough, else null."""
    return F.when((s > sh) & (s > 0.3), "S").when((sh > s) & (sh > 0.25), "SH")


def fricative_track(signals: DataFrame) -> DataFrame:
    """(utt_id, t, class) of signals; class may be null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, *r) for u, rate, y in zip(batch["utt_id"], batch["rate"], batch["samples"], strict=True) for r in acoustics.band_shares(np.asarray(y, float), int(rate))]
            yield pd.DataFrame(rows, columns=["utt_id", "t", "sh", "s"])

    shares = signals.select("utt_id", "rate", "samples").mapInPandas(run, "utt_id string, t double, sh double, s double")
    return shares.select("utt_id", "t", fricative_class(F.col("sh"), F.col("s")).alias("class"))


def segment_summary(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """Per segment (utt_id, start, end): f0 mean and range, intensity mean, formants at the frame nearest to the middle.

    frames: (utt_id, t, f0, f1, f2, f3, intensity).
    """
    met = segments.alias("s").join(frames.alias("f"), (F.col("s.utt_id") == F.col("f.utt_id")) & (F.col("f.t") >= F.col("s.start")) & (F.col("f.t") < F.col("s.end")), "left")
    middle = F.abs(F.col("f.t") - (F.col("s.start") + F.col("s.end")) / 2)
    return met.groupBy("s.utt_id", "s.start", "s.end").agg(
        F.avg("f.f0").alias("f0_mean"), (F.max("f.f0") - F.min("f.f0")).alias("f0_range"), F.avg("f.intensity").alias("intensity"), *[F.min_by(f"f.{k}", middle).alias(k) for k in ("f1", "f2", "f3")]
    )


def grid(segments: DataFrame, step: float = 0.005) -> DataFrame:
    """(utt_id, start, end, t): sampling points inside each segment."""
    steps = F.sequence(F.lit(0), F.floor((F.col("end") - F.col("start")) / step).cast("int"))
    return segments.withColumn("t", F.explode(F.transform(steps, lambda k: F.round(F.col("start") + k * step, 6)))).filter("t < end")
