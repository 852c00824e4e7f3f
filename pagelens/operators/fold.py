"""Ordered folds that no window expresses: rows of a key in order, with only the state held."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, key: str | list[str], order: list[str], begin: Callable[[], Any], step: Callable[[Any, tuple], tuple | list[tuple]], schema: str) -> DataFrame:
    """A row of ``step(state, row)``, or a list of rows, for each row of ``df``, with a fresh ``begin()`` for each key.

    Keys are dealt by hash and sorted within a partition, so a key's rows stream
    past one state: memory does not grow with the key, nor the cost of a row
    with its place. ``row`` holds the columns of ``df`` in order; a null key is a
    key of its own. An empty table gives none.
    """
    keys = [key] if isinstance(key, str) else key
    at = [df.columns.index(k) for k in keys]
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Any = object()
        state: Any = None
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
                own = [row[k] for k in at]
                if own != now:
                    now, state = own, begin()
                made = step(state, row)
                out.extend(made) if isinstance(made, list) else out.append(made)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
