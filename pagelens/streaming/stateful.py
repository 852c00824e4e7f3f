"""Stream forms with keyed state: refs, loops, back-off and budgets, row for row as their batch forms.

The state store must be RocksDB's (``spark.sql.streaming.stateStore.providerClass``).
Rows of a key must arrive in order between batches; within a batch they are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagelens.operators.logs import LIMITS, WALL_CLOCK_S, Budget, seconds
from pagelens.operators.refs import SCOPE, UNIT, RefBook, plain


def gathered(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """A batch's rows of one key, in order."""
    return pd.concat(list(rows)).sort_values(list(order), kind="stable")


class KeyMap:
    """A map state as a mapping of strings to numbers, for the reads of one call.

    Each access of the state asks the JVM: a key is asked for once, and never in
    a scope that is ``new`` and has none; what changed is written once, by ``flush``.
    """

    def __init__(self, state, new: bool = False) -> None:
        self.state, self.new = state, new
        self.seen: dict[str, int | None] = {}
        self.changed: set[str] = set()

    def get(self, key: str) -> int | None:
        if key not in self.seen:
            self.seen[key] = self.state.getValue((key,))[0] if not self.new and self.state.containsKey((key,)) else None
        return self.seen[key]

    def __setitem__(self, key: str, ref: int) -> None:
        if self.seen.get(key) != ref:
            self.seen[key] = ref
            self.changed.add(key)

    def flush(self) -> None:
        for key in self.changed:
            self.state.updateValue((key,), (self.seen[key],))
        self.changed.clear()


class RefProcessor(StatefulProcessor):
    """``RefBook`` over a stored map of keys."""

    def __init__(self, names: list[str]) -> None:
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "key string", "ref long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count = self.count.get()
        known = KeyMap(self.known, new=count is None)
        book = RefBook(known, 0 if count is None else count[0])
        reads = gathered(rows, "token")
        out = [(*key, token, *x) for token, units in zip(reads["token"], reads["units"]) for x in book.bind(plain(units))]
        known.flush()
        self.count.update((book.count,))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def bind_reads_stream(reads: DataFrame) -> DataFrame:
    """``bind_reads`` over a stream of reads ``(handle, frame, kind, token, units)``, as ``reads_of`` makes them: a read is one row."""
    kinds = {f.name: f.dataType.simpleString() for f in reads.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*SCOPE, "token")) + ", " + UNIT
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return reads.select(*SCOPE, "token", "units").groupBy(*SCOPE).transformWithStateInPandas(RefProcessor(names), schema, "Append", "None")


class LoopProcessor(StatefulProcessor):
    """The last signatures of a session in a list of bounded length."""

    def __init__(self, same: int, window: int, alternate: int) -> None:
        self.same, self.window, self.alternate = same, window, alternate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "sig string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        calls = gathered(rows, "seq")
        loops = []
        for sig in calls["sig"]:
            recent = [*recent, sig][-self.window :]
            last = recent[-self.alternate :]
            flips = len(last) == self.alternate and last[0] != last[1] and all(x == last[i % 2] for i, x in enumerate(last))
            loops.append("repeat" if recent.count(sig) >= self.same else "alternation" if flips else None)
        self.recent.put([(x,) for x in recent])
        yield pd.DataFrame({"session": key[0], "seq": calls["seq"].to_numpy(), "sig": calls["sig"].to_numpy(), "loop": loops})

    def close(self) -> None:
        pass


def loop_detect_stream(calls: DataFrame, same: int = 5, window: int = 20, alternate: int = 8) -> DataFrame:
    """``loop_detect`` over a stream of ``calls(session, seq, sig)``; ``sig`` must not be null."""
    kind = calls.schema["session"].dataType.simpleString()
    rows = calls.select("session", F.col("seq").cast("long").alias("seq"), F.col("sig").cast("string").alias("sig"))
    return rows.groupBy("session").transformWithStateInPandas(LoopProcessor(same, window, alternate), f"session {kind}, seq long, sig string, loop string", "Append", "None")


class BackoffProcessor(StatefulProcessor):
    """The latest end of a domain's waits and who asked for it; a timer at that end deletes both."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "until double, owner int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, owner = self.open.get() if self.open.exists() else (None, None)
        before = until
        answers = gathered(rows, "t", "seq")
        out = []
        for seq, t, status, wait in answers[["seq", "t", "status", "wait"]].itertuples(index=False, name=None):
            refused = until is not None and until > t
            out.append((key[0], seq, refused, owner if refused else None))
            if wait == wait and wait > 0 and (until is None or (t + wait, status) > (until, owner)):
                until, owner = t + wait, int(status)
        if until != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(until * 1000) + 1)
        if until is not None:
            self.open.update((until, owner))
        yield pd.DataFrame(out, columns=["domain", "seq", "refused", "owner_status"]).astype({"owner_status": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def backoff_stream(responses: DataFrame, default_s: float = 60.0, watermark: str = "10 minutes") -> DataFrame:
    """``backoff_windows`` over a stream of ``responses(domain, ts, seq, status, wait)``: ``domain, seq, refused, owner_status``.

    A domain's state is deleted once event time, less the watermark, has passed
    the end of its wait; a row that could still be refused is late by then.
    """
    kind = responses.schema["domain"].dataType.simpleString()
    wait = F.when(F.col("status").isin(429, 503), F.coalesce(F.col("wait").cast("double"), F.lit(default_s)))
    rows = responses.withWatermark("ts", watermark).select("domain", "ts", seconds("ts").alias("t"), F.col("seq").cast("long").alias("seq"), F.col("status").cast("int").alias("status"), wait.alias("wait"))
    return rows.groupBy("domain").transformWithStateInPandas(BackoffProcessor(), f"domain {kind}, seq long, refused boolean, owner_status int", "Append", "EventTime")


class BudgetProcessor(StatefulProcessor):
    """``Budget`` with its counters and origins stored."""

    def __init__(self, limits: dict[str, int], wall_clock: float) -> None:
        self.limits, self.wall_clock = limits, wall_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "began double, action int, navigation int, download int")
        self.origins = handle.getMapState("origins", "origin string", "known boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        budget = Budget(self.limits, self.wall_clock)
        if self.spent.exists():
            budget.began, budget.action, budget.navigation, budget.download = self.spent.get()
            budget.origins = {k[0] for k in self.origins.keys()}
        before = set(budget.origins)
        calls = gathered(rows, "seq")
        calls = calls.astype(object).where(calls.notna(), None)
        refused = [budget.charge(*x) for x in calls[["t", "kind", "origin"]].itertuples(index=False, name=None)]
        self.spent.update((budget.began, budget.action, budget.navigation, budget.download))
        for origin in budget.origins - before:
            self.origins.updateValue((origin,), (True,))
        yield pd.DataFrame({"session": key[0], "seq": calls["seq"].to_numpy(), "refused": refused})

    def close(self) -> None:
        pass


def charge_calls_stream(calls: DataFrame, limits: dict[str, int] | None = None, wall_clock: float = WALL_CLOCK_S) -> DataFrame:
    """``charge_budget`` over a stream of ``calls(session, seq, ts, kind, origin)``, with wall clock and origins."""
    kind = calls.schema["session"].dataType.simpleString()
    rows = calls.select("session", F.col("seq").cast("long").alias("seq"), seconds("ts").alias("t"), "kind", "origin")
    return rows.groupBy("session").transformWithStateInPandas(BudgetProcessor({**LIMITS, **(limits or {})}, wall_clock), f"session {kind}, seq long, refused string", "Append", "None")

