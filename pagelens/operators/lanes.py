"""Outcome statistics per host and lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OUTCOMES = ("ok", "blocked", "dropped")
#: Counts are halved when the latest evidence is older than this at the next observation; stale in reports.
HALVE_DAYS, STALE_DAYS = 30, 60


RECORD = "ok int, blocked int, dropped int, last string, last_ok date, last_bad date, vendor string, wall string"
NO_RECORD = "named_struct('ok', 0, 'blocked', 0, 'dropped', 0, 'last', cast(null as string), 'last_ok', cast(null as date), 'last_bad', cast(null as date), 'vendor', cast(null as string), 'wall', cast(null as string))"


def lane_fold(days: Column, start: Column) -> Column:
    """Fold of the days of one lane, in order, onto a record.

    Before the first observation of a day all counts are halved (rounded down) if
    the latest evidence is over ``HALVE_DAYS`` old; those after it only count.
    """

    def step(a: Column, x: Column) -> Column:
        latest = F.greatest(a["last_ok"], a["last_bad"])
        old = F.coalesce(F.date_diff(x["day"], latest) > HALVE_DAYS, F.lit(False))
        n = lambda o: (F.when(old, F.floor(a[o] / 2).cast("int")).otherwise(a[o]) + x[o]).alias(o)
        return F.struct(
            *map(n, OUTCOMES), F.when(x["last"] == "ok", "ok").otherwise("bad").alias("last"),
            F.when(x["ok"] > 0, F.greatest(a["last_ok"], x["day"])).otherwise(a["last_ok"]).alias("last_ok"),
            F.when(x["blocked"] + x["dropped"] > 0, F.greatest(a["last_bad"], x["day"])).otherwise(a["last_bad"]).alias("last_bad"),
            F.coalesce(x["vendor"], a["vendor"]).alias("vendor"), F.coalesce(x["wall"], a["wall"]).alias("wall"),
        )

    return F.aggregate(days, start, step)


def record_outcomes(facts: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """One record per (host, lane) of ``facts(host, lane, outcome, day, seq, vendor, wall)``; unknown outcomes and null keys are left out.

    The observations of a day are counted first, with the last one and the latest
    vendor and wall by ``seq``, before anything is shuffled; what meets in the
    ordered fold is a row per day of a lane, however many observations it had.
    ``records``, an earlier result, is carried on; facts must not be older than it.
    """
    rows = facts.where(F.col("outcome").isin(*OUTCOMES) & F.col("host").isNotNull() & F.col("lane").isNotNull())
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    daily = rows.groupBy("host", "lane", "day").agg(*(F.count_if(F.col("outcome") == o).cast("int").alias(o) for o in OUTCOMES), F.max_by("outcome", F.struct("seq", "outcome")).alias("last"), last("vendor"), last("wall"))
    days = daily.groupBy("host", "lane").agg(F.array_sort(F.collect_list(F.struct("day", *OUTCOMES, "last", "vendor", "wall"))).alias("days"))
    if records is None:
        return days.select("host", "lane", lane_fold(F.col("days"), F.expr(NO_RECORD)).alias("r")).select("host", "lane", "r.*")
    kept = records.select("host", "lane", F.struct("ok", "blocked", "dropped", "last", "last_ok", "last_bad", "vendor", "wall").cast(f"struct<{RECORD.replace(' ', ':').replace(',:', ',')}>").alias("r"))
    both = kept.join(days, ["host", "lane"], "full")
    folded = F.when(F.col("days").isNull(), F.col("r")).otherwise(lane_fold(F.col("days"), F.coalesce("r", F.expr(NO_RECORD))))
    return both.select("host", "lane", folded.alias("r")).select("host", "lane", "r.*")


def belief() -> Column:
    return F.when(F.col("last") == "ok", "believed_good").when((F.col("last") == "bad") & (F.col("blocked") + F.col("dropped") >= F.col("ok")), "believed_bad").otherwise("unknown")


def lookup(wanted: DataFrame, records: DataFrame, today: Column) -> DataFrame:
    """What is known of each ``wanted(host, lane, siblings)``: the host, then its parents down to two labels; the lane, then its siblings in order.

    ``siblings`` is an array of lanes of the same engine. Null columns where
    nothing is known.
    """
    labels = F.split("host", r"\.")
    up = F.transform(F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    asked = wanted.select("host", "lane", F.posexplode(up).alias("up", "at"), "siblings")
    lanes = F.concat(F.array("lane"), F.array_sort(F.coalesce("siblings", F.array().cast("array<string>"))))
    tried = asked.select("host", "lane", "up", "at", F.posexplode(lanes).alias("sib", "try_lane"))
    known = records.withColumn("belief", belief()).select(F.col("host").alias("at"), F.col("lane").alias("try_lane"), "belief", F.greatest("last_ok", "last_bad").alias("latest"))
    hits = tried.join(known, ["at", "try_lane"]).groupBy("host", "lane").agg(F.min(F.struct("up", "sib", "at", "try_lane", "belief", "latest")).alias("b"))
    out = wanted.select("host", "lane").join(hits, ["host", "lane"], "left")
    age = F.date_diff(today, F.col("b.latest"))
    return out.select("host", "lane", F.col("b.at").alias("known_host"), F.col("b.try_lane").alias("known_lane"), "b.belief", (F.col("b.up") == 0).alias("exact_host"), (F.col("b.sib") > 0).alias("from_sibling"), age.alias("age_days"), (age > STALE_DAYS).alias("stale"))


def lanes_report(records: DataFrame) -> DataFrame:
    """Per host the lanes believed good, newest first, and whether all that are known failed."""
    rows = records.withColumn("belief", belief())
    good = F.when(F.col("belief") == "believed_good", F.struct(F.col("last_ok").alias("d"), "lane"))
    return rows.groupBy("host").agg(F.array_join(F.reverse(F.array_sort(F.collect_list(good)))["lane"], ",").alias("good_lanes"), F.min(F.col("belief") == "believed_bad").alias("all_failed"), F.count("*").alias("lanes"))


def export_lanes(records: DataFrame, scope: str = "blocked-only", min_observations: int = 1) -> DataFrame:
    total = F.col("ok") + F.col("blocked") + F.col("dropped")
    kept = records.where(total >= min_observations)
    return kept if scope == "all" else kept.where(F.col("blocked") + F.col("dropped") > 0)


def import_lanes(local: DataFrame, incoming: DataFrame, label: str) -> DataFrame:
    """Counts add, dates take the later; the incoming ``last`` wins only with strictly newer evidence; ``source`` marks records that are new."""
    a, b = local.alias("a"), incoming.alias("b")
    j = a.join(b, ["host", "lane"], "full")
    newest = lambda s: F.greatest(F.col(f"{s}.last_ok"), F.col(f"{s}.last_bad"))
    newer = F.coalesce(newest("b") > newest("a"), newest("a").isNull())
    return j.select("host", "lane", *((F.coalesce(f"a.{o}", F.lit(0)) + F.coalesce(f"b.{o}", F.lit(0))).alias(o) for o in OUTCOMES), F.when(newer, F.coalesce("b.last", "a.last")).otherwise(F.coalesce("a.last", "b.last")).alias("last"), F.greatest("a.last_ok", "b.last_ok").alias("last_ok"), F.greatest("a.last_bad", "b.last_bad").alias("last_bad"), F.coalesce("a.vendor", "b.vendor").alias("vendor"), F.coalesce("a.wall", "b.wall").alias("wall"), F.when(F.col("a.last").isNull(), label).alias("source"))


def evict(records: DataFrame, max_hosts: int = 5000) -> DataFrame:
    """Keep the hosts with the newest evidence."""
    hosts = records.groupBy("host").agg(F.min(F.greatest("last_ok", "last_bad")).alias("oldest")).orderBy(F.desc("oldest"), "host").limit(max_hosts)
    return records.join(hosts.select("host"), "host", "left_semi")


def import_report(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """``records, new_hosts, new_records, conflicts`` of an import, in one row, which writes nothing: a dry run.

    A conflict is a record of both sides whose ``last`` differ.
    """
    hosts = local.select("host").distinct().withColumn("__host", F.lit(True))
    mine = local.select("host", "lane", F.col("last").alias("__last"), F.lit(True).alias("__known"))
    j = incoming.select("host", "lane", "last").join(hosts, "host", "left").join(mine, ["host", "lane"], "left")
    fresh = F.col("__host").isNull()
    return j.agg(F.count("*").alias("records"), F.count_distinct(F.when(fresh, F.col("host"))).alias("new_hosts"), F.count_if(F.col("__known").isNull()).alias("new_records"), F.count_if(F.col("__known") & ~F.col("last").eqNullSafe(F.col("__last"))).alias("conflicts"))


def forget(records: DataFrame, host: str | None = None, source: str | None = None) -> DataFrame:
    """Records without a site and its subdomains, or without those that came from ``source``; none without either."""
    if source is not None:
        kept = records.where(~F.col("source").eqNullSafe(F.lit(source)))
        return kept if host is None else forget(kept, host)
    if host is None:
        return records.where(F.lit(False))
    return records.where((F.col("host") != host) & ~F.endswith("host", F.lit("." + host)))


def coerce_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)``: a record is rejected whole if a count is negative or missing, a date malformed or its key null."""
    fine = F.col("host").isNotNull() & F.col("lane").isNotNull()
    for o in OUTCOMES:
        fine = fine & F.coalesce(F.col(o).try_cast("int") >= 0, F.lit(False))
    for day in ("last_ok", "last_bad"):
        fine = fine & (F.col(day).isNull() | F.coalesce(F.col(day).cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col(day).cast("string").try_cast("date").isNotNull(), F.lit(False)))
    return raw.where(fine), raw.where(~fine)
