"""Getting the package to the executors, and the folder they share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors' Python, once per application.

    Spark serves the archive itself, so executors need no folder in common with
    the driver.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "pagelens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("pagelens", os.path.relpath(full, here)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one on a ``local`` master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: steps after it do not repeat what came before.

    The driver deletes the table when it ends, not before: a result that reads it
    may still be asked for.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagelens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch sent to a Python worker; long texts make small batches.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Keep Arrow batches under ``limit`` bytes, however long the texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, str(2**31 - 1)).rstrip("b")
    if now.isdigit() and int(now) > limit:  # a setting with a unit is the user's own choice
        spark.conf.set(key, str(limit))


#: Rows of a table of rules or of the caller's own wishes that are sent to every task; a larger one is shuffled.
FEW_RULES = 10_000


def few(rules: DataFrame) -> DataFrame:
    """A table of rules, broadcast if it is counted to be small."""
    return F.broadcast(rules) if rules.count() <= FEW_RULES else rules
