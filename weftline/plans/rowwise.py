"""Python kernels row by row over Arrow columns: the objects of one row at a time, results as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Items of results that are Python objects at once, but for those of a single row.
ITEMS = 10_000


def listed(kind: StructType, kernel: Callable[..., Iterable[tuple] | None]) -> Callable:
    """A function of columns: the list of structs that kernel(values of a row) gives as tuples, null for None."""

    def run(*columns: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        parts, pending, ends, at = [], [], [], 0

        def flush() -> None:
            values = zip(*pending, strict=True) if pending else [[]] * arrow.num_fields
            parts.append(pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], fields=list(arrow)))
            pending.clear()

        for row in range(len(columns[0])):
            found = kernel(*(c[row].as_py() for c in columns))
            ends.append(None if found is None else at)
            before = len(pending)
            pending.extend(found or ())
            at += len(pending) - before
            if len(pending) >= ITEMS:
                flush()
        flush()
        return pa.ListArray.from_arrays(pa.array([*ends, at], pa.int32()), pa.concat_arrays(parts))

    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ArrayType(kind))
