"""Tables written to the shared folder to cut lineage.

The folder is the one that the cluster names in spark.checkpoint.dir. Only
where that is unset, in local sessions, a folder of our own is used. Tables
are removed when the operator that wrote them says so, or when Python ends.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_kept: dict[str, SparkSession] = {}
#: Names of the tables that have one, by path.
_tables: dict[str, str] = {}
#: Folders of local sessions, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, or one of our own in a local session, gone when Python ends."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or _own.get(context.applicationId)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own[context.applicationId] = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table; a missing one is no error."""
    _kept.pop(path, None)
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in list(_kept.items()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone by now
            _kept.pop(path, None)


class Scratch:
    """The tables that one call of an operator writes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{shared_folder(spark)}/weftline-{uuid.uuid4().hex}", {}

    def write(self, name: str, df: DataFrame, heavy: bool = False) -> DataFrame:
        """Write the rows and return a reader of the table; heavy: release the shuffle files that computed them."""
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        _kept[path] = self.spark
        self.paths[name] = path
        del df
        if heavy:
            self.release()
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))

    def bucketed(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """Write the rows in buckets of a key, so that joins on it read them where they are and shuffle only the other side."""
        path, n = f"{self.base}/{name}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"weftline_{uuid.uuid4().hex}"
        df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(table)
        _kept[path], self.paths[name], _tables[path] = self.spark, path, table
        del df
        self.release()
        return self.spark.table(table)

    def ranked(self, name: str, df: DataFrame, column: str, *order: str | F.Column) -> DataFrame:
        """The rows with their place in a global order, gapless from 0; many tasks sort, and only partition sizes meet."""
        rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("weftline_at", F.monotonically_increasing_id())
        rows = self.write(name, rows)
        part = F.shiftright("weftline_at", 33)
        sizes = sorted((r[0], r[1]) for r in rows.groupBy(part).count().collect())  # one for each partition
        before, offsets = 0, []
        for k, n in sizes:
            offsets.append((k, before))
            before += n
        offset = F.broadcast(self.spark.createDataFrame(offsets, "weftline_part long, weftline_before long"))
        found = rows.join(offset, part == F.col("weftline_part"))
        place = F.col("weftline_before") + F.col("weftline_at").bitwiseAND((1 << 33) - 1)
        return found.withColumn(column, place).drop("weftline_at", "weftline_part", "weftline_before")

    def drop_all_but(self, *names: str) -> None:
        """Drop what is not needed to read the result."""
        self.drop(*[n for n in self.paths if n not in names])

    def release(self) -> None:
        """Let Spark delete shuffle files of plans that are no longer referenced."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
