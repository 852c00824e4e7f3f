"""Writing tables out, with receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_table(df: DataFrame, path: str, format: str = "csv", order: str = "row_ix", max_rows: int = 5000) -> DataFrame:
    """Write the first ``max_rows`` rows by ``order`` (a report) and return one receipt row: rows written, columns, total, truncated.

    CSV lines end in CR LF and start with a header.
    """
    total = df.count()
    rows = df.orderBy(order).limit(max_rows)
    writer = rows.coalesce(1).write.mode("overwrite")
    if format == "csv":
        writer.option("header", True).option("lineSep", "\r\n").csv(path)
    elif format == "json":
        writer.json(path)
    else:
        raise ValueError(f"format {format} is neither csv nor json")
    return df.sparkSession.range(1).select(F.lit(min(total, max_rows)).alias("rows_written"), F.lit(len(df.columns)).alias("columns"), F.lit(total).alias("total_rows"), F.lit(total > max_rows).alias("truncated"))


def append_audit(batch: DataFrame, path: str) -> None:
    """Append audit records as JSON lines; for a stream pass it to ``foreachBatch``."""
    batch.write.mode("append").json(path)
