"""Running a stream to its end, and folding batches into a stored table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from pagelens.session import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame) -> DataFrame:
    """All rows that an append-mode stream gives for what its sources hold now, as a stored table.

    Keyed state needs RocksDB's store; the session's own setting is put back.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


class VersionedTable:
    """A stored table with a version for each batch folded into it; a version counts once its ``_SUCCESS`` is there.

    The latest two versions are kept, so a reader of the one before is not cut off.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def folder(self, version: int) -> str:
        return f"{self.path}/version={version:019d}"

    def versions(self) -> list[int]:
        """Complete versions, oldest first: a name for each batch that is kept, so no more than a few."""
        if not self.fs.exists(self.at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at) if s.isDirectory()]
        found = sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return [v for v in found if self.fs.exists(done(f"{self.folder(v)}/_SUCCESS"))]

    def read(self, before: int | None = None) -> DataFrame | None:
        """The latest complete version (older than ``before``), or ``None``."""
        known = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(self.folder(known[-1])) if known else None

    def fold(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame | None], DataFrame]) -> bool:
        """Write version ``batch_id``: ``merge(batch, latest)``. A batch that comes again, or after a later one, changes nothing; returns whether it counted."""
        known = self.versions()
        if known and known[-1] >= batch_id:
            return False
        merge(batch, self.read(batch_id)).write.mode("overwrite").parquet(self.folder(batch_id))
        for old in known[:-1]:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(old)), True)
        return True


def fold_into(stream: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame], checkpoint: str) -> DataStreamWriter:
    """A writer that folds each batch of ``stream`` into the ``VersionedTable`` at ``path``; start it with a trigger.

    A batch is repeated after a failure with the same number, so it counts once.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        VersionedTable(batch.sparkSession, path).fold(batch, batch_id, merge)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
