"""What several operators share: scratch tables, bounded Arrow batches, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.session import bounded_batches  # noqa: F401


def unused(name: str, *dfs: DataFrame) -> str:
    """``name``, made longer until no column of ``dfs`` is called so."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, which must be named; on one machine alone a temporary one may stand in."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/pagelens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote, once nothing lazy reads it any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that are written and no longer referenced.

    Its cleaner follows the driver's garbage collection, which a quiet driver
    may not run for long.
    """
    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row per node, ``(id, root)``.

    ``root`` is the smallest id of the component. Each round links the larger
    neighbours of every node to the smallest of its neighbourhood, and then the
    smaller neighbours of every node to the smallest of them, until nothing
    changes: the number of edges never grows, stars take two rounds and chains a
    number that follows the logarithm of their length. ``min`` is combined before
    each shuffle, hence a hub is no hot task. A count and a checksum per round
    reach the driver. Null ends and loops are ignored; an empty input gives an
    empty result.

    Raises ``RuntimeError`` if ``max_rounds`` do not suffice, never a part result.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    state = cut(e.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct())
    seen = None
    for _ in range(max_rounds):
        now = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("big", "small"))).first())
        if now == seen or not now[0]:
            return state.select(F.col("big").alias("id"), F.col("small").alias("root")).union(state.select("small", "small").distinct())
        seen = now
        ends = state.union(state.select("small", "big")).toDF("u", "v")
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("small"), F.least("u", "m").alias("m"))
        large = state.join(least, "small").select("big", F.col("m").alias("small")).distinct()
        lowest = large.groupBy("big").agg(F.min("small").alias("m"))
        turned = large.join(lowest, "big").where("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small"))
        after = cut(turned.union(lowest).distinct())
        drop_cut(state)
        state = after
    raise RuntimeError("components did not settle")
