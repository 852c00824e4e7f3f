"""Stream forms of the log operators, keyed as their batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelens.operators.logs import console_shape

WATERMARK = "10 minutes"


def console_shape_counts(stream: DataFrame, window: str = "5 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Messages of each shape in tumbling windows of event time ``ts``; later rows than the watermark are left out."""
    shaped = stream.withWatermark("ts", watermark).withColumn("shape", console_shape(F.col("text")))
    return shaped.groupBy(F.window("ts", window), "level", "shape").agg(F.count("*").alias("n")).select("window.start", "window.end", "level", "shape", "n")


def request_counts(stream: DataFrame, window: str = "5 minutes", slide: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """Requests of each type in sliding windows."""
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", window, slide), "resource_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "resource_type", "n")


def call_sessions(stream: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Calls of each session between gaps."""
    return stream.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "session").agg(F.count("*").alias("n_calls")).select("session_window.start", "session_window.end", "session", "n_calls")


def without_repeats(stream: DataFrame, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    """The first of rows that repeat ``keys`` within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def charge_budget_stream(stream: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Each call of ``stream(session, seq, kind)`` with ``refused``, one state of counters per session.

    A session's calls must arrive in order of ``seq`` between batches; within a
    batch they are sorted. Refused calls are not billed.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        actions, navigations, downloads = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(parts)).sort_values("seq")
        refused: list[str | None] = []
        for kind in rows["kind"]:
            why = "action" if actions >= limits["action"] else "navigation" if kind == "navigation" and navigations >= limits["navigation"] else "download" if kind == "download" and downloads >= limits["download"] else None
            if why is None:
                actions, navigations, downloads = actions + 1, navigations + (kind == "navigation"), downloads + (kind == "download")
            refused.append(why)
        state.update((actions, navigations, downloads))
        yield pd.DataFrame({"session": key[0], "seq": rows["seq"].to_numpy(), "refused": refused})

    return stream.groupBy("session").applyInPandasWithState(fold, "session long, seq long, refused string", "actions long, navigations long, downloads long", "append", GroupStateTimeout.NoTimeout)
