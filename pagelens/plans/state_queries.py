"""Registered queries on lanes, monitors, identity and budgeted views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.operators import identity as I
from pagelens.operators import lanes as N
from pagelens.operators import monitor as M
from pagelens.operators import refs as R
from pagelens.plans.log_queries import events
from pagelens.plans.registry import query
from pagelens.session import shared_dir
from pagelens.streaming import stateful as K
from pagelens.streaming.run import VersionedTable, drain

LANE_SQL = "case when event_type in ('view', 'click') then 'headless' else 'headed' end"
OUTCOME_SQL = "case event_type when 'error' then 'blocked' when 'signup' then 'dropped' else 'ok' end"
FACTS_SQL = f"facts as (select 'h' || user_id % 20 || '.example.com' as host, {LANE_SQL} as lane, {OUTCOME_SQL} as outcome, cast(ts as date) + cast((event_id % 97) * 7 as integer) as day, event_id as seq from events)"
FOLD_SQL = f"""{FACTS_SQL},
o as (select *, row_number() over (partition by host, lane order by day, seq) as rn from facts),
f as (select host, lane, rn, (outcome = 'ok')::int as ok, (outcome = 'blocked')::int as blocked, (outcome = 'dropped')::int as dropped, outcome = 'ok' as good, case when outcome = 'ok' then day end as last_ok, case when outcome <> 'ok' then day end as last_bad from o where rn = 1
union all
select o.host, o.lane, o.rn, (case when h then f.ok // 2 else f.ok end) + (o.outcome = 'ok')::int, (case when h then f.blocked // 2 else f.blocked end) + (o.outcome = 'blocked')::int, (case when h then f.dropped // 2 else f.dropped end) + (o.outcome = 'dropped')::int, o.outcome = 'ok', case when o.outcome = 'ok' then o.day else f.last_ok end, case when o.outcome <> 'ok' then o.day else f.last_bad end
from f join o on o.host = f.host and o.lane = f.lane and o.rn = f.rn + 1, lateral (select o.day - greatest(coalesce(f.last_ok, f.last_bad), coalesce(f.last_bad, f.last_ok)) > 30 as h)),
rec as (select host, lane, ok, blocked, dropped, case when good then 'ok' else 'bad' end as last, last_ok, last_bad from (select *, row_number() over (partition by host, lane order by rn desc) as k from f) where k = 1)"""


def facts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(
        F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string"), F.lit(".example.com")).alias("host"), F.expr(LANE_SQL).alias("lane"), F.expr(OUTCOME_SQL).alias("outcome"),
        F.date_add(F.col("ts").cast("date"), ((F.col("event_id") % 97) * 7).cast("int")).alias("day"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("vendor"), F.lit(None).cast("string").alias("wall"),
    )


@query("i3_record_outcomes", f"with recursive {FOLD_SQL} select * replace (last_ok::varchar as last_ok, last_bad::varchar as last_bad) from rec")
def i3_record_outcomes(spark: SparkSession, d: str) -> DataFrame:
    out = N.record_outcomes(facts(spark, d)).drop("vendor", "wall")
    return out.withColumn("last_ok", F.col("last_ok").cast("string")).withColumn("last_bad", F.col("last_bad").cast("string"))


@query("i4_belief", f"with recursive {FOLD_SQL} select host, lane, case when last = 'ok' then 'believed_good' when blocked + dropped >= ok then 'believed_bad' else 'unknown' end as belief from rec")
def i4_belief(spark: SparkSession, d: str) -> DataFrame:
    return N.record_outcomes(facts(spark, d)).select("host", "lane", N.belief().alias("belief"))


@query("i7_export_lanes", f"with recursive {FOLD_SQL} select host, lane, ok, blocked, dropped from rec where ok + blocked + dropped >= 3 and blocked + dropped > 0")
def i7_export_lanes(spark: SparkSession, d: str) -> DataFrame:
    return N.export_lanes(N.record_outcomes(facts(spark, d)), min_observations=3).select("host", "lane", "ok", "blocked", "dropped")


@query("i9_evict", f"with recursive {FOLD_SQL}, h as (select host, min(greatest(coalesce(last_ok, last_bad), coalesce(last_bad, last_ok))) as oldest from rec group by 1) select host, lane from rec where host in (select host from h order by oldest desc, host limit 7)")
def i9_evict(spark: SparkSession, d: str) -> DataFrame:
    return N.evict(N.record_outcomes(facts(spark, d)), 7).select("host", "lane")


@query("i10_forget", f"with recursive {FOLD_SQL} select host, lane from rec where host <> 'h3.example.com'")
def i10_forget(spark: SparkSession, d: str) -> DataFrame:
    return N.forget(N.record_outcomes(facts(spark, d)), "h3.example.com").select("host", "lane")


CHECKS_SQL = "select user_id as monitor_id, event_id as seq, epoch(ts) as tsec, event_type not in ('error', 'signup') as ok, event_type = 'signup' as blocked, event_type as value from events"


def checks(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events(spark, d).select(F.col("user_id").alias("monitor_id"), F.col("event_id").alias("seq"), at.alias("at"), at.alias("observed_at"), (~F.col("event_type").isin("error", "signup")).alias("ok"), (F.col("event_type") == "signup").alias("blocked"), F.col("event_type").alias("value"), F.lit("hash").alias("condition"))


@query(
    "j2_fires",
    f"with c as ({CHECKS_SQL}), b as (select *, last_value(case when ok then value end ignore nulls) over (partition by monitor_id order by tsec rows between unbounded preceding and 1 preceding) as before from c) select monitor_id, seq, coalesce(ok and before <> value, false) as fired from b",
)
def j2_fires(spark: SparkSession, d: str) -> DataFrame:
    return M.checks_fired(checks(spark, d)).select("monitor_id", "seq", "fired")


@query(
    "j3_monitor_state",
    f"""with recursive c as (select *, row_number() over (partition by monitor_id order by tsec, seq) as rn from ({CHECKS_SQL})),
    f as (select monitor_id, rn, (not ok and not blocked)::int as failures, false as paused, 1 as checks from c where rn = 1
    union all select c.monitor_id, c.rn, case when f.paused then f.failures when c.ok then 0 when c.blocked then f.failures else f.failures + 1 end, f.paused or (case when c.ok then 0 when c.blocked then f.failures else f.failures + 1 end) >= 6, f.checks + (not f.paused)::int from f join c on c.monitor_id = f.monitor_id and c.rn = f.rn + 1)
    select monitor_id, failures, paused, checks from (select *, row_number() over (partition by monitor_id order by rn desc) as k from f) where k = 1""",
)
def j3_monitor_state(spark: SparkSession, d: str) -> DataFrame:
    return M.monitor_state(checks(spark, d)).select("monitor_id", "failures", "paused", "checks")


@query(
    "j7_daily_ceiling",
    f"""with recursive c as (select *, row_number() over (partition by monitor_id order by tsec, seq) as rn from ({CHECKS_SQL})),
    f as (select monitor_id, seq, rn, tsec as opened, 1 as n, false as refused from c where rn = 1
    union all select c.monitor_id, c.seq, c.rn, case when w then c.tsec else f.opened end, (case when w then 0 else f.n end) + ((case when w then 0 else f.n end) < 2)::int, (case when w then 0 else f.n end) >= 2 from f join c on c.monitor_id = f.monitor_id and c.rn = f.rn + 1, lateral (select c.tsec - f.opened > 86400 as w))
    select monitor_id as owner, seq, refused from f""",
)
def j7_daily_ceiling(spark: SparkSession, d: str) -> DataFrame:
    return M.daily_ceiling(checks(spark, d).withColumnRenamed("monitor_id", "owner"), 2)


@query("j8_restart_gaps", f"with c as ({CHECKS_SQL}) select monitor_id, greatest(floor((1706745600.0 - max(tsec)) / 3600.0), 0)::bigint as missed from c group by 1")
def j8_restart_gaps(spark: SparkSession, d: str) -> DataFrame:
    last = checks(spark, d).groupBy("monitor_id").agg(F.max("at").alias("last_attempt")).withColumn("created", F.lit(0.0)).withColumn("interval", F.lit(3600.0))
    return M.restart_gaps(last, 1706745600.0).select("monitor_id", "missed")


SNAP_SQL = "select user_id % 10 as handle, user_id as ref, arg_max(event_type, event_id) as name, arg_max(event_id % 3, event_id) as landmark from events where {} group by all"


def snapshot(spark: SparkSession, d: str, when: str) -> DataFrame:
    e = events(spark, d).where(when)
    return e.groupBy((F.col("user_id") % 10).alias("handle"), F.col("user_id").alias("ref")).agg(F.max_by("event_type", "event_id").alias("name"), F.max_by(F.col("event_id") % 3, "event_id").alias("landmark"))


@query(
    "f7_snapshot_diff",
    f"""with b as ({SNAP_SQL.format("event_id % 2 = 0")}), a as ({SNAP_SQL.format("event_id % 2 = 1")})
    select * from (select coalesce(a.handle, b.handle) as handle, coalesce(a.ref, b.ref) as ref, case when b.ref is null then 'added' when a.ref is null then 'removed' when a.name <> b.name or a.landmark <> b.landmark then 'changed' end as change,
    case when a.ref is not null and b.ref is not null and (a.name <> b.name or a.landmark <> b.landmark) then concat_ws(',', case when a.name <> b.name then 'name' end, case when a.landmark <> b.landmark then 'landmark' end) end as fields from a full join b on a.handle = b.handle and a.ref = b.ref) where change is not null""",
)
def f7_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return I.snapshot_diff(snapshot(spark, d, "event_id % 2 = 0"), snapshot(spark, d, "event_id % 2 = 1"), ("name", "landmark"))


@query("f4_mark_gone", f"with b as ({SNAP_SQL.format('event_id % 2 = 0')}), a as ({SNAP_SQL.format('event_id % 2 = 1')}) select handle, ref, name from b where ref not in (select ref from a)")
def f4_mark_gone(spark: SparkSession, d: str) -> DataFrame:
    before = snapshot(spark, d, "event_id % 2 = 0").withColumn("anchor", F.struct(F.lit("link").alias("role"), "name")).withColumn("scoped", F.lit(False))
    return I.mark_gone(before, snapshot(spark, d, "event_id % 2 = 1")).select("handle", "ref", "name")


@query("f8_retain_reads", "select handle, token, age <= 5 as retained from (select user_id as handle, event_id as token, row_number() over (partition by user_id order by ts desc, event_id desc) as age from events)")
def f8_retain_reads(spark: SparkSession, d: str) -> DataFrame:
    return I.retain_reads(events(spark, d).select(F.col("user_id").alias("handle"), F.col("event_id").alias("token"), "ts")).select("handle", "token", "retained")


@query(
    "f9_batch_outcome",
    """with i as (select user_id as batch, event_id as pos, event_id as ref, case event_type when 'error' then 'STALE' when 'click' then 'REBOUND' else 'OK' end as outcome from events), w as (select *, min(case when outcome = 'STALE' then pos end) over (partition by batch) as fb from i)
    select batch, count(*) filter (fb is null or pos < fb) as completed, count(*) filter ((fb is null or pos < fb) and outcome = 'REBOUND') as rebound, max(fb) as failed_ref, coalesce(string_agg(ref::varchar, ',' order by pos) filter (pos > fb), '') as not_attempted from w group by 1""",
)
def f9_batch_outcome(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "STALE").when(F.col("event_type") == "click", "REBOUND").otherwise("OK")
    items = events(spark, d).select(F.col("user_id").alias("batch"), F.col("event_id").alias("pos"), F.col("event_id").alias("ref"), outcome.alias("outcome"))
    return I.batch_outcome(items).select("batch", "completed", "rebound", F.col("failed.ref").alias("failed_ref"), "not_attempted")


UNIT_KEYS = """list_filter([case when k % 5 = 0 then 'testid:p|main||t' || k % 11 end, case when k % 3 = 0 then 'id:p|main||i' || k % 13 end, case when event_type = 'purchase' then 'named-control:p|main||purchase|f' || k % 4 end, case when k % 4 = 0 then 'role-name-scoped:p|main||' || event_type || '|n' || k % 17 || '|b' || k % 3 end, 'role-name-landmark:p|main||' || event_type || '|n' || k % 17], lambda x: x is not null)"""
#: The fold unit by unit: the state is the map of keys, the refs that the read has used and the number of refs.
REFS_SQL = f"""e as (select user_id as handle, case when event_type in ('error', 'signup') then 'inner' else '' end as frame, case event_type when 'click' then 'control' else 'link' end as kind, event_id as ord, event_type, cast(regexp_extract(props, '[0-9]+') as int) as k, cast(ntile(5) over (partition by user_id order by event_id) as bigint) as token from events),
    ks as (select *, {UNIT_KEYS} as keys from e),
    single as (select handle, frame, kind, token, key from (select handle, frame, kind, token, unnest(keys) as key from ks) group by all having count(*) = 1),
    own as (select ks.handle, ks.frame, ks.kind, ks.token, ks.ord, list_filter(any_value(ks.keys), lambda x: list_contains(coalesce(list(s.key), []), x)) as keys from ks left join single s on s.handle = ks.handle and s.frame = ks.frame and s.kind = ks.kind and s.token = ks.token and list_contains(ks.keys, s.key) group by ks.handle, ks.frame, ks.kind, ks.token, ks.ord),
    u as (select *, row_number() over (partition by handle, frame, kind order by token, ord) as rn from own),
    f as (select distinct handle, frame, kind, 0::bigint as rn, 0::bigint as token, 0::bigint as ord, 0::bigint as ref, '' as key_kind, false as turn_local, false as minted, map([], [])::map(varchar, bigint) as known, []::bigint[] as used, 0::bigint as n from u
    union all select handle, frame, kind, rn, token, ord, ref, key_kind, turn_local, minted, case when len(keys) = 0 then known else map_concat(known, map(keys, list_transform(keys, lambda x: ref))) end, list_append(spent, ref), n + minted::int
    from (select u.*, f.known, case when u.token = f.token then f.used else []::bigint[] end as spent, f.n,
        list_filter(u.keys, lambda x: f.known[x] is not null and not list_contains(case when u.token = f.token then f.used else []::bigint[] end, f.known[x]))[1] as hit,
        coalesce(f.known[hit], f.n + 1) as ref, split_part(coalesce(hit, u.keys[1], 'turn-local'), ':', 1) as key_kind, len(u.keys) = 0 as turn_local, hit is null as minted
        from f join u on u.handle = f.handle and u.frame = f.frame and u.kind = f.kind and u.rn = f.rn + 1)),
    bound as (select handle, frame, kind, token, ord, ref, key_kind, turn_local, minted from f where rn > 0)"""


def ref_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of five reads per user: event kinds as frames and kinds of units, numbers of the properties as attributes."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    e = events(spark, d).withColumn("k", k).withColumn("token", F.ntile(5).over(W.partitionBy("user_id").orderBy("event_id")).cast("long"))
    some = lambda test, prefix, n: F.when(test, F.concat(F.lit(prefix), (F.col("k") % n).cast("string")))
    anchor = F.struct(
        F.lit("p").alias("page_key"), F.col("event_type").alias("role"), some(F.lit(True), "n", 17).alias("name"), F.lit("main").alias("landmark"), F.lit("").alias("landmark_label"), some(F.col("k") % 4 == 0, "b", 3).alias("labelled_ancestor"),
        some(F.col("k") % 3 == 0, "i", 13).alias("attr_id"), some(F.col("k") % 5 == 0, "t", 11).alias("attr_testid"), some(F.col("event_type") == "purchase", "f", 4).alias("attr_name"),
    )
    frame, kind = F.when(F.col("event_type").isin("error", "signup"), "inner").otherwise(""), F.when(F.col("event_type") == "click", "control").otherwise("link")
    return e.select(F.col("user_id").alias("handle"), frame.alias("frame"), kind.alias("kind"), "token", F.col("event_id").alias("ord"), anchor.alias("anchor"))


@query("f3_bind_reads", f"with recursive {REFS_SQL} select * from bound")
def f3_bind_reads(spark: SparkSession, d: str) -> DataFrame:
    return R.bind_reads(ref_units(spark, d))


@query(
    "f3_ref_entries",
    f"""with recursive {REFS_SQL}, full_reads as (select handle, frame, max(token) as full_read from bound group by all), named as (select b.*, e.event_type as role, 'n' || e.k % 17 as name from bound b join e on e.ord = b.ord),
    entries as (select handle, frame, kind, ref, min(token) as minted, max(token) as seen, arg_max(key_kind, token) as key_kind, arg_max(role, token) as role, arg_max(name, token) as name, arg_max(turn_local, token) as turn_local from named group by all)
    select handle, frame, kind, ref, minted, seen, key_kind, turn_local, full_read > seen as gone, case when full_read > seen then role || ' "' || name || '"' end as gone_as from entries join full_reads using (handle, frame)""",
)
def f3_ref_entries(spark: SparkSession, d: str) -> DataFrame:
    units = ref_units(spark, d)
    return R.ref_entries(R.bind_reads(units), units).drop("role", "name")


@query("j9_ref_stream", f"with recursive {REFS_SQL} select * from bound")
def j9_ref_stream(spark: SparkSession, d: str) -> DataFrame:
    """The registry as a stream of reads, which are stored first as a source would."""
    reads = R.reads_of(ref_units(spark, d))
    path = f"{shared_dir(spark)}/reads-{uuid.uuid4().hex}"
    reads.write.parquet(path)
    return drain(K.bind_reads_stream(spark.readStream.schema(reads.schema).parquet(path)))


@query("i3_folded_batches", f"with recursive {FOLD_SQL} select * replace (last_ok::varchar as last_ok, last_bad::varchar as last_bad) from rec")
def i3_folded_batches(spark: SparkSession, d: str) -> DataFrame:
    """The lane records from three batches folded one after the other into a stored table, the second one twice."""
    stored = VersionedTable(spark, f"{shared_dir(spark)}/lanes-{uuid.uuid4().hex}")
    rows = facts(spark, d)
    part = F.when(F.col("day") < F.lit("2024-06-01"), 0).when(F.col("day") < F.lit("2025-01-01"), 1).otherwise(2)
    for batch in (0, 1, 1, 2):
        stored.fold(rows.where(part == batch), batch, N.record_outcomes)
    out = stored.read().drop("vendor", "wall")
    return out.withColumn("last_ok", F.col("last_ok").cast("string")).withColumn("last_bad", F.col("last_bad").cast("string"))


J3_SQL = f"""c as (select *, row_number() over (partition by monitor_id order by tsec, seq) as rn from ({CHECKS_SQL})),
    f as (select monitor_id, rn, (not ok and not blocked)::int as failures, false as paused, 1::bigint as checks, tsec as last_attempt, case when ok then tsec end as last_ok, case when not blocked then not ok else false end as last_failed, case when blocked then tsec + 900 end as blocked_until from c where rn = 1
    union all select monitor_id, rn, failures, failures >= 6, checks, last_attempt, last_ok, last_failed, blocked_until from (select c.monitor_id, c.rn, case when f.paused then f.failures when c.ok then 0 when c.blocked then f.failures else f.failures + 1 end as failures, f.checks + (not f.paused)::int as checks,
        case when f.paused then f.last_attempt else c.tsec end as last_attempt, case when c.ok and not f.paused then c.tsec else f.last_ok end as last_ok, case when f.paused or c.blocked then f.last_failed else not c.ok end as last_failed, case when c.blocked and not f.paused then c.tsec + 900 else f.blocked_until end as blocked_until
        from f join c on c.monitor_id = f.monitor_id and c.rn = f.rn + 1)),
    last as (select * exclude (rn) from (select *, row_number() over (partition by monitor_id order by rn desc) as k from f) where k = 1)"""


def waits(spark: SparkSession, d: str) -> DataFrame:
    """Checks of which all but purchases and clicks fail or are blocked, with the end of each block."""
    return checks(spark, d).withColumn("blocked_until", F.when(F.col("blocked"), F.col("at") + 900))


@query("j3_folded_batches", f"with recursive {J3_SQL} select monitor_id, failures, paused, checks, last_attempt, last_ok, last_failed, blocked_until from last")
def j3_folded_batches(spark: SparkSession, d: str) -> DataFrame:
    """Monitor states from three batches folded one after the other into a stored table, the second one twice."""
    stored = VersionedTable(spark, f"{shared_dir(spark)}/monitors-{uuid.uuid4().hex}")
    part = F.when(F.col("at") < 1704931200, 0).when(F.col("at") < 1705795200, 1).otherwise(2)
    for batch in (0, 1, 1, 2):
        stored.fold(waits(spark, d).where(part == batch), batch, M.monitor_state)
    return stored.read()


@query("j3_check_history", f"select monitor_id, seq, age from (select *, row_number() over (partition by monitor_id order by tsec desc, seq desc) as age from ({CHECKS_SQL})) where age <= 50")
def j3_check_history(spark: SparkSession, d: str) -> DataFrame:
    return M.check_history(checks(spark, d)).select("monitor_id", "seq", F.col("age").cast("long").alias("age"))


READ_SQL = "select user_id % 10 as handle, case when user_id % 7 = 0 then user_id + {1} else user_id end as ref, arg_max(event_type, event_id) as name, arg_max(event_id % 3, event_id) as landmark, user_id % 7 = 0 as turn_local, case user_id % 3 when 0 then 'link' when 1 then 'button' else 'field' end as kind from events where {0} group by user_id"


def read_of(spark: SparkSession, d: str, when: str, shift: int) -> DataFrame:
    """A snapshot whose units of every seventh user get a new ref with each read."""
    local = F.col("user_id") % 7 == 0
    kind = F.when(F.col("user_id") % 3 == 0, "link").when(F.col("user_id") % 3 == 1, "button").otherwise("field")
    e = events(spark, d).where(when).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("name"), F.max_by(F.col("event_id") % 3, "event_id").alias("landmark"))
    return e.select((F.col("user_id") % 10).alias("handle"), (F.col("user_id") + F.when(local, shift).otherwise(0)).alias("ref"), "name", "landmark", local.alias("turn_local"), kind.alias("kind"))


@query(
    "f7_delta_summary",
    f"""with b as ({READ_SQL.format("event_id % 2 = 0 and user_id % 11 <> 1", 1000)}), a as ({READ_SQL.format("event_id % 2 = 1 and user_id % 11 <> 2", 2000)}),
    j as (select coalesce(a.handle, b.handle) as handle, a.kind, b.ref is not null as old, a.ref is not null as new, a.turn_local as al, b.turn_local as bl, a.name = b.name and a.landmark = b.landmark as same from a full join b on a.handle = b.handle and a.ref = b.ref),
    c as (select handle, count(*) filter (not old and not al) as added, count(*) filter (not new and not bl) as removed, count(*) filter (old and new and not same) as changed, count(*) filter (old and new and same) as stable, count(*) filter (not old and al) as re_minted from j group by 1),
    k as (select handle, string_agg(kind || '=' || n, ', ' order by kind) as stable_by_kind from (select handle, kind, count(*) as n from j where old and new and same group by 1, 2) group by 1)
    select handle, added, removed, changed, stable, coalesce(stable_by_kind, '') as stable_by_kind, re_minted, handle % 2 = 1 as navigated from c left join k using (handle)""",
)
def f7_delta_summary(spark: SparkSession, d: str) -> DataFrame:
    before, after = read_of(spark, d, "event_id % 2 = 0 and user_id % 11 <> 1", 1000), read_of(spark, d, "event_id % 2 = 1 and user_id % 11 <> 2", 2000)
    urls = before.select("handle").union(after.select("handle")).distinct().select("handle", F.lit("/a").alias("url_before"), F.when(F.col("handle") % 2 == 1, "/b").otherwise("/a").alias("url_after"))
    return I.delta_summary(before, after, urls, ("name", "landmark"))


@query(
    "i8_import_report",
    f"""with recursive {FOLD_SQL}, mine as (select * from rec where host not like 'h1%'), theirs as (select * replace (case when lane = 'headed' then 'bad' else last end as last) from rec where host not like 'h2%')
    select count(*) as records, count(distinct t.host) filter (t.host not in (select host from mine)) as new_hosts, count(*) filter (m.host is null) as new_records, count(*) filter (m.last <> t.last) as conflicts from theirs t left join mine m on m.host = t.host and m.lane = t.lane""",
)
def i8_import_report(spark: SparkSession, d: str) -> DataFrame:
    records = N.record_outcomes(facts(spark, d))
    theirs = records.where(~F.col("host").startswith("h2")).withColumn("last", F.when(F.col("lane") == "headed", "bad").otherwise(F.col("last")))
    return N.import_report(records.where(~F.col("host").startswith("h1")), theirs)
