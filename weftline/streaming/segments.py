"""Streams: live segments stored once, unseen rows, running windows, gap merging across batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def once(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Rows whose keys have not been seen; state is dropped once the watermark is past."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def once_for_ever(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys have never been seen; state grows with the number of keys."""
    return stream.dropDuplicates(keys)


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by key and tumbling or sliding window."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Contiguous activity: the streaming form of merging rows that are less than a gap apart."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys).agg(F.count("*").alias("n"))


def store(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataStreamWriter:
    """Writes each batch under its own number: a batch that is run again replaces what it wrote, so nothing is stored twice."""

    def save(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def poll_seconds(target: int) -> int:
    """How often a live playlist of that target duration is read."""
    return max(1, target // 2)


def start(writer: DataStreamWriter, target: int) -> StreamingQuery:
    """Start a query that polls at half the target duration; a poll that fails is read again by the next."""
    return writer.trigger(processingTime=f"{poll_seconds(target)} seconds").start()


def stop_when(queries: list[StreamingQuery], done: Callable[[], bool], every: float = 0.2) -> None:
    """Wait until `done()`, or a query ends, and stop the others after the batch that they are in."""
    while not done() and all(q.isActive for q in queries):
        time.sleep(every)
    for q in queries:
        q.stop()
    failed = [q.exception() for q in queries if q.exception() is not None]
    if failed:
        raise failed[0]


def decode_rows(stream: DataFrame, decode: Callable[[dict], dict], schema: str) -> DataFrame:
    """Applies a function to every row; a row that fails has its error in `error`, the rest go on."""
    names = [f.name for f in stream.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                try:
                    rows.append({**decode(row), "error": None})
                except Exception as error:  # noqa: BLE001 - one bad row must not end the stream
                    rows.append({"error": repr(error)})
            yield pd.DataFrame(rows, columns=[*names, "error"])

    return stream.mapInPandas(run, f"{schema}, error string")


class Playlist(DataSource):
    """Live playlists as a stream of (stream, url, place). Options: path, one file or URL, or paths, several at blanks.

    The offset holds what each playlist listed last; it advances only when a
    batch is planned, so a batch that fails is read again. A playlist that
    cannot be read lists nothing new until it can.
    """

    @classmethod
    def name(cls) -> str:
        return "weftline_playlist"

    def schema(self) -> str:
        return "stream string, url string, place int"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _PlaylistReader((self.options.get("paths") or self.options["path"]).split())


class _PlaylistReader(SimpleDataSourceStreamReader):
    """Reads playlists again and again; lines that are new since the last poll are the new rows."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    @staticmethod
    def _urls(path: str) -> list[str] | None:
        from urllib.request import urlopen

        try:
            with urlopen(path if "://" in path else f"file://{path}", timeout=30) as found:  # noqa: S310 - the caller's own playlist
                lines = found.read().decode("utf-8", "replace").splitlines()
        except OSError:
            return None
        return [line.strip() for line in lines if line.strip() and not line.strip().startswith("#")]

    def initialOffset(self) -> dict:
        return {"seen": {}}

    @staticmethod
    def _new(start: dict, end: dict) -> Iterator[tuple]:
        for path, urls in sorted(end["seen"].items()):
            seen = set(start["seen"].get(path, ()))
            yield from ((path, u, k) for k, u in enumerate(u for u in urls if u not in seen))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"seen": {p: start["seen"].get(p, []) if (urls := self._urls(p)) is None else urls for p in self.paths}}
        return iter(list(self._new(start, end))), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._new(start, end)


__all__ = ["Playlist", "decode_rows", "once", "once_for_ever", "poll_seconds", "sessions", "start", "stop_when", "store", "windowed"]
