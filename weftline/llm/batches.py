"""Running a numpy kernel over the texts of a table, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.kernels import Texts, slices

#: Bytes of rows that Spark puts into one Arrow batch, so that very long texts do not meet in one.
BATCH_BYTES = "4194304"

Kernel = Callable[[pa.RecordBatch, Texts], dict[str, "np.ndarray | list | pa.Array"]]


def bounded(df: DataFrame) -> None:
    """Limit Arrow batches by bytes, unless the session has its own limit."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """The table less the columns of those names, whatever their case."""
    gone = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in gone])


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """The table with columns c0, c1 and so on, the new name of each column, and what selects the old ones back."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names, [F.col(n).alias(c) for c, n in names.items()]


def map_texts(df: DataFrame, text: str, kernel: Kernel, schema: str) -> DataFrame:
    """New rows from texts: kernel(rows, texts) returns the columns of any number of rows."""
    bounded(df)
    out = T._parse_datatype_string(schema)
    names, arrow = out.names, _arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(batch.schema.get_field_index(text))):
                found = kernel(batch.slice(part.first, len(part)), part)
                if found and len(found[names[0]]):
                    yield pa.RecordBatch.from_arrays([pa.array(found[n], t) for n, t in zip(names, arrow, strict=True)], names=names)

    return df.mapInArrow(run, out)


def append_columns(df: DataFrame, text: str, kernel: Kernel, schema: str) -> DataFrame:
    """The rows with further columns, one value a row, that kernel(rows, texts) returns.

    Columns of the input that have a name of the new ones (in any case) are replaced.
    """
    bounded(df)
    added = T._parse_datatype_string(schema)
    names, arrow = added.names, _arrow(added)
    gone = {n.lower() for n in names}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    at = df.columns.index(text)
    keep = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in gone]
    titles = [f.name for f in kept] + names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(at)):
                rows = batch.slice(part.first, len(part))
                found = kernel(rows, part)
                yield pa.RecordBatch.from_arrays([rows.column(i) for i in keep] + [pa.array(found[n], t) for n, t in zip(names, arrow, strict=True)], names=titles)

    return df.mapInArrow(run, T.StructType(kept + added.fields))


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]
