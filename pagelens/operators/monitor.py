"""Change monitors in batch: observations, transitions, state and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions.normal import normal_form
from pagelens.operators.fold import ordered_fold

#: Failures after which a monitor pauses itself; order of states in a report.
MAX_FAILURES = 6
STATE_ORDER = ("stale", "blocked", "suspended", "changed", "paused", "never_checked", "unchanged")


def content_hash(text: Column) -> Column:
    """Digest of the text in NFC with its white space squashed: what looks the same is the same."""
    return F.sha2(T.squash(normal_form(text, "NFC")), 256)


def observe(pages: DataFrame, monitors: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Value of each monitor on each page version: ``monitors(monitor_id, url, condition, needle)`` met on the url with ``pages(url, observed_at, text)``.

    A ``hash`` monitor digests the text, a ``count`` one counts its needle (a
    regular expression) and the others look whether it stands there. Monitors
    with a ``selector`` (``#id``, ``.class`` or a tag) look at that element of
    ``nodes(url, observed_at, …)`` alone, the first in order; its absence is a
    failure, as is a page without text. ``count`` with a selector counts the
    elements.
    """
    chosen = "selector" in monitors.columns and nodes is not None
    whole = monitors.where(F.col("selector").isNull()) if chosen else monitors
    keys = ["monitor_id", "observed_at", "condition"]
    seen = pages.join(whole, "url").select(*keys, "needle", "text", F.lit(None).cast("long").alias("n"))
    if chosen:
        asked = pages.select("url", "observed_at").join(monitors.where(F.col("selector").isNotNull()), "url")
        units = nodes.where("tag not like '#%'").select("url", "observed_at", "page_id", "node_id", "last_desc", F.explode(F.array_distinct(F.concat(F.array("tag"), F.coalesce(F.array(F.concat(F.lit("#"), F.col("attrs")["id"])), F.array()), F.transform(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), lambda c: F.concat(F.lit("."), c))))).alias("selector"))
        hits = asked.join(units, ["url", "observed_at", "selector"]).groupBy("url", "observed_at", *[c for c in asked.columns if c not in ("url", "observed_at")]).agg(F.min(F.struct("page_id", "node_id", "last_desc")).alias("first"), F.count("*").alias("n"))
        runs = nodes.where("tag = '#text'").select("url", "observed_at", F.col("node_id").alias("t"), "own_text")
        inside = hits.join(runs, ["url", "observed_at"]).where(F.col("t").between(F.col("first.node_id"), F.col("first.last_desc")))
        texts = inside.groupBy("monitor_id", "url", "observed_at").agg(F.array_join(F.array_sort(F.collect_list(F.struct("t", "own_text")))["own_text"], "").alias("text"))
        found = asked.join(hits.select("monitor_id", "url", "observed_at", "n"), ["monitor_id", "url", "observed_at"], "left").join(texts, ["monitor_id", "url", "observed_at"], "left")
        seen = seen.unionByName(found.select(*keys, "needle", F.when(F.col("n").isNotNull(), F.coalesce("text", F.lit(""))).alias("text"), "n"))
    seen = seen.withColumn("hash", content_hash(F.col("text")))
    value = F.when(F.col("condition") == "hash", F.col("hash")).when(F.col("condition") == "count", F.coalesce("n", F.regexp_count("text", F.col("needle")).cast("long")).cast("string")).otherwise(F.contains("text", F.col("needle")).cast("string"))
    return seen.select(*keys, value.alias("value"), F.col("text").isNotNull().alias("ok"))


def fires(condition: Column, before: Column, after: Column) -> Column:
    """Whether a condition fires; nothing fires without an earlier value."""
    change = condition.isin("hash", "count") & (before != after)
    edge = ((condition == "appears") & (before == "false") & (after == "true")) | ((condition == "gone") & (before == "true") & (after == "false"))
    return F.coalesce(change | edge, F.lit(False))


def checks_fired(checks: DataFrame) -> DataFrame:
    """``checks(monitor_id, observed_at, ok, condition, value)`` with ``fired``: compared with the last successful value."""
    w = W.partitionBy("monitor_id").orderBy("observed_at").rowsBetween(W.unboundedPreceding, -1)
    before = F.last(F.when(F.col("ok"), F.col("value")), ignorenulls=True).over(w)
    return checks.withColumn("before", before).withColumn("fired", F.col("ok") & fires(F.col("condition"), F.col("before"), F.col("value")))


MONITOR = "failures int, paused boolean, checks long, last_attempt double, last_ok double, last_failed boolean, blocked_until double"
NEW_MONITOR = "named_struct('failures', 0, 'paused', false, 'checks', 0L, 'last_attempt', cast(null as double), 'last_ok', cast(null as double), 'last_failed', false, 'blocked_until', cast(null as double))"
#: Seconds of checks that are summed up before a monitor's parts meet.
CHUNK_S = 86_400


def monitor_fold(chunks: Column, start: Column) -> Column:
    """Fold of the parts of one monitor's checks, in order, onto a state: failures in a row, pause at ``MAX_FAILURES``, last attempt and success.

    Once paused, later checks change nothing. The failures before a part's first
    success add to those carried in; those after its last one are carried on.
    """
    state = lambda *v: F.struct(*(x.alias(c.strip().split(" ")[0]) for x, c in zip(v, MONITOR.split(","))))

    def step(a: Column, c: Column) -> Column:
        carried = F.get(F.filter(c["early"], lambda x: x["run"] == MAX_FAILURES - a["failures"]), F.lit(0))
        paused = lambda at, last_ok: state(F.lit(MAX_FAILURES), F.lit(True), a["checks"] + at["rn"], at["at"], last_ok, F.lit(True), F.coalesce(at["until"], a["blocked_until"]))
        failures = F.when(c["succeeded"], c["late"]).otherwise(a["failures"] + c["late"])
        new = state(failures, F.lit(False), a["checks"] + c["n"], c["last_attempt"], F.coalesce(c["last_ok"], a["last_ok"]), F.coalesce(c["last_failed"], a["last_failed"]), F.coalesce(c["until"], a["blocked_until"]))
        return F.when(a["paused"], a).when(carried.isNotNull(), paused(carried, a["last_ok"])).when(c["inner"].isNotNull(), paused(c["inner"], c["inner"]["last_ok"])).otherwise(new)

    return F.aggregate(chunks, start, step)


def monitor_state(checks: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """State of each monitor after all of ``checks(monitor_id, at, seq, ok, blocked)``, with ``blocked_until`` if the checks have it.

    A blocked check counts as no failure and leaves the last verdict as it was.
    Checks are summed up by monitor and day, in as many tasks as there are days;
    what meets in the ordered fold is a row per day, however many checks it had.
    ``states``, an earlier result, is carried on; checks must not be older than it.
    """
    until = F.col("blocked_until") if "blocked_until" in checks.columns else F.lit(None)
    rows = checks.select("monitor_id", F.col("at").cast("double").alias("at"), "seq", F.coalesce("ok", F.lit(False)).alias("ok"), (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("ok", F.lit(False))).alias("blocked"), until.cast("double").alias("until"))
    rows = rows.withColumn("chunk", F.floor(F.col("at") / CHUNK_S)).withColumn("failed", ~F.col("ok") & ~F.col("blocked"))
    so_far = W.partitionBy("monitor_id", "chunk").orderBy("at", "seq").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("rn", F.count("*").over(so_far)).withColumn("good", F.count_if("ok").over(so_far)).withColumn("bad", F.count_if("failed").over(so_far))
    rows = rows.withColumn("run", (F.col("bad") - F.coalesce(F.max(F.when(F.col("ok"), F.col("bad"))).over(so_far), F.lit(0))).cast("int"))
    rows = rows.withColumn("last_ok", F.last(F.when(F.col("ok"), F.col("at")), True).over(so_far)).withColumn("until_now", F.last(F.when(F.col("blocked"), F.col("until")), True).over(so_far))
    here = F.struct("rn", "at", "last_ok", F.col("until_now").alias("until"))
    early = F.col("failed") & (F.col("good") == 0) & (F.col("run") <= MAX_FAILURES)
    parts = rows.groupBy("monitor_id", "chunk").agg(
        F.count("*").alias("n"), F.max_by("at", "rn").alias("last_attempt"), F.max_by("last_ok", "rn").alias("last_ok"), F.max_by("run", "rn").alias("late"), F.max_by("until_now", "rn").alias("until"),
        F.max_by("failed", F.when(~F.col("blocked"), F.col("rn"))).alias("last_failed"), (F.max("good") > 0).alias("succeeded"),
        F.collect_list(F.when(early, F.struct("run", "rn", "at", F.col("until_now").alias("until")))).alias("early"),
        F.min(F.when(F.col("failed") & (F.col("good") > 0) & (F.col("run") == MAX_FAILURES), here)).alias("inner"),
    )
    each = parts.groupBy("monitor_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "n", "last_attempt", "last_ok", "late", "until", "last_failed", "succeeded", "early", "inner"))).alias("parts"))
    if states is None:
        return each.select("monitor_id", monitor_fold(F.col("parts"), F.expr(NEW_MONITOR)).alias("s")).select("monitor_id", "s.*")
    kept = states.select("monitor_id", F.struct(*(F.col(c.split(" ")[0]).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in MONITOR.split(", "))).alias("s"))
    both = kept.join(each, "monitor_id", "full")
    folded = F.when(F.col("parts").isNull(), F.col("s")).otherwise(monitor_fold(F.col("parts"), F.coalesce("s", F.expr(NEW_MONITOR))))
    return both.select("monitor_id", folded.alias("s")).select("monitor_id", "s.*")


def check_history(checks: DataFrame, keep: int = 50) -> DataFrame:
    """The newest ``keep`` checks of each monitor, as ``age`` counts them from 1."""
    newest = W.partitionBy("monitor_id").orderBy(F.desc("at"), F.desc("seq"))
    return checks.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= keep)


def state_of(now: Column) -> Column:
    """Report state of a monitor row; the first condition that holds."""
    return (
        F.when(F.coalesce("unreadable", F.lit(False)), "blocked")
        .when(F.coalesce("suspended", F.lit(False)), "suspended")
        .when(F.coalesce(F.col("blocked_until") > now, F.lit(False)), "blocked")
        .when(F.coalesce("last_failed", F.lit(False)) | F.coalesce(now - F.col("last_attempt") > 2 * F.col("interval"), F.lit(False)), "stale")
        .when(F.coalesce("paused", F.lit(False)), "paused")
        .when(F.col("last_attempt").isNull(), "never_checked")
        .when(F.coalesce("fired_since_report", F.lit(False)), "changed")
        .otherwise("unchanged")
    )


def report(states: DataFrame) -> DataFrame:
    """Counts per state in report order."""
    rank = F.array_position(F.array(*map(F.lit, STATE_ORDER)), F.col("state")).cast("int")
    return states.groupBy("state").agg(F.count("*").alias("n")).withColumn("rank", rank)


def due_checks(monitors: DataFrame, now: float, batch: int = 3, floor_s: float = 300.0) -> DataFrame:
    """The next ``batch`` active monitors due, in store order, with their next time: the interval times 0.9 to 1.1 by a hash, so it can be repeated."""
    jitter = 0.9 + F.pmod(F.xxhash64("monitor_id", "checks"), F.lit(1000)) / 1000 * 0.2
    due = monitors.where(F.col("active") & (F.col("next_due") <= now)).orderBy("pos").limit(batch)
    return due.withColumn("new_due", F.lit(now) + F.greatest(F.col("interval"), F.lit(floor_s)) * jitter)


def daily_ceiling(checks: DataFrame, ceiling: int = 500, window_s: float = 86_400.0) -> DataFrame:
    """``checks(owner, at, seq)`` with ``refused``; refused checks are not billed.

    A window opens at its first check and closes after ``window_s``, so each
    rests on the one before it: an ordered fold with two numbers of state.
    """

    def step(state: list, row: tuple) -> tuple:
        owner, at, seq = row
        if state[0] is None or at - state[0] > window_s:
            state[:] = [at, 0]
        refused = state[1] >= ceiling
        state[1] += not refused
        return owner, seq, refused

    kind = checks.select("owner").schema[0].dataType.simpleString()
    rows = checks.select("owner", F.col("at").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"))
    return ordered_fold(rows, "owner", ["at", "seq"], lambda: [None, 0], step, f"owner {kind}, seq long, refused boolean")


def restart_gaps(monitors: DataFrame, now: float) -> DataFrame:
    """Checks missed while nothing ran."""
    return monitors.withColumn("missed", F.greatest(F.floor((F.lit(now) - F.coalesce("last_attempt", "created")) / F.col("interval")), F.lit(0)).cast("long"))
