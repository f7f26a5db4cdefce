"""Recordings and images as tables: segments of WAV files, pluggable scorers, stores, candidate paths.

Formats other than PCM WAV need a decoder that the caller passes in.
"""

from __future__ import annotations

import gzip
import io
import uuid
import wave
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16_000
Decoder = Callable[[bytes], tuple[np.ndarray, int]]


def wav(data: bytes) -> tuple[np.ndarray, int]:
    """(samples from -1 to 1 as one channel, rate) of a PCM file."""
    with wave.open(io.BytesIO(data)) as file:
        width, channels, rate = file.getsampwidth(), file.getnchannels(), file.getframerate()
        raw = file.readframes(file.getnframes())
    if width == 1:
        samples = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    else:
        samples = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / float(1 << (8 * width - 1))
    return samples.reshape(-1, channels).mean(1), rate


def resample(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation to another rate."""
    if rate == to or not len(samples):
        return samples
    at = np.arange(int(round(len(samples) * to / rate))) * rate / to
    return np.interp(at, np.arange(len(samples)), samples)


def read_media(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files below a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def cut_segments(segments: DataFrame, media: DataFrame, decode: Decoder = wav, rate: int = RATE) -> DataFrame:
    """(path, segment, start, end, samples): segments (path, segment, start, end) of recordings at one rate."""
    listed = segments.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("segment", "start", "end"))).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                samples, had = decode(bytes(row.content))
                samples = resample(samples, had, rate)
                out = [(row.path, p["segment"], p["start"], p["end"], samples[int(p["start"] * rate) : int(p["end"] * rate)].tolist()) for p in row.parts]
                yield pd.DataFrame(out, columns=["path", "segment", "start", "end", "samples"])

    return media.join(listed, "path").mapInPandas(run, "path string, segment int, start double, end double, samples array<double>")


def posteriors(cuts: DataFrame, score: Callable[[np.ndarray], np.ndarray], rate: int = RATE) -> DataFrame:
    """(path, segment, t, logits, shift): frames by a scorer of samples; the shift is the duration over the frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                samples = np.asarray(row.samples, float)
                found = np.asarray(score(samples), float)
                shift = len(samples) / rate / max(len(found), 1)
                yield pd.DataFrame({"path": row.path, "segment": row.segment, "t": range(len(found)), "logits": found.tolist(), "shift": shift})

    return cuts.mapInPandas(run, "path string, segment int, t int, logits array<double>, shift double")


def page_sizes(media: DataFrame, sizes: Callable[[bytes], list[tuple[int, int]]]) -> DataFrame:
    """(path, page_index, width, height) of images and documents, by a decoder of the caller's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, k, w, h) for p, data in zip(batch["path"], batch["content"], strict=True) for k, (w, h) in enumerate(sizes(bytes(data)))]
            yield pd.DataFrame(rows, columns=["path", "page_index", "width", "height"])

    return media.mapInPandas(run, "path string, page_index int, width int, height int")


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists, in any store that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(conf).exists(at):
            return path
    raise FileNotFoundError(", ".join(paths))


def samples(rows: DataFrame, order: Sequence[str], most: int | None = None, utt_id: str | None = None) -> DataFrame:
    """The first `most` rows in an order, with an utterance id: the given column, or utt_<place>."""
    ranked = rows.orderBy(*order) if most is None else rows.orderBy(*order).limit(most)
    if utt_id is not None:
        return ranked.withColumn("utt_id", F.col(utt_id).cast("string"))
    from weftline.operators.islands import sequential

    return sequential(ranked.withColumn("weftline_all", F.lit(0)), ["weftline_all"], order, "weftline_place").withColumn("utt_id", F.format_string("utt_%06d", F.col("weftline_place"))).drop("weftline_all", "weftline_place")


def read_hub(spark: SparkSession, uri: str, mount: Callable[[str, str], str], kind: str = "parquet") -> DataFrame:
    """Read an hf://owner/repo/path URI below the folder where `mount(owner, repo)` makes the repository available."""
    owner, repo, *rest = uri.removeprefix("hf://").split("/", 2)
    return spark.read.format(kind).load("/".join([mount(owner, repo).rstrip("/"), *rest]))


def warc_record(url: str, payload: bytes, date: str, record_id: str) -> bytes:
    """One gzipped WARC response record."""
    head = {"WARC-Type": "response", "WARC-Target-URI": url, "WARC-Date": date, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(payload))}
    text = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + payload + b"\r\n\r\n", mtime=0)


def warc_records(responses: DataFrame) -> DataFrame:
    """(url, record) of responses (url, payload, fetched_at); records of many rows may be written one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, warc_record(u, bytes(p), t, str(uuid.uuid5(uuid.NAMESPACE_URL, f"{u} {t}")))) for u, p, t in zip(batch["url"], batch["payload"], batch["at"], strict=True)]
            yield pd.DataFrame(rows, columns=["url", "record"])

    stamped = responses.select("url", "payload", F.date_format(F.to_utc_timestamp("fetched_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    return stamped.mapInPandas(run, "url string, record binary")


class Store(Protocol):
    """Where notebooks and reports are kept; an object with these can stand in for any storage."""

    def read(self, path: str) -> str: ...

    def write(self, text: str, path: str) -> None: ...

    def listdir(self, path: str) -> list[str]: ...

    def pretty_path(self, path: str) -> str: ...


class SparkStore:
    """Text files in whatever store Spark's own paths reach."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.conf)

    def read(self, path: str) -> str:
        at, files = self._at(path)
        stream = files.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str, path: str) -> None:
        at, files = self._at(path)
        stream = files.create(at, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def listdir(self, path: str) -> list[str]:
        at, files = self._at(path)
        return sorted(s.getPath().getName() for s in files.listStatus(at))

    def pretty_path(self, path: str) -> str:
        return self._at(path)[0].toString()
