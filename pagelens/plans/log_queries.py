"""Registered queries that read ``events`` as request, console and audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators import logs as G
from pagelens.plans.registry import query
from pagelens.sources.pages import read_table
from pagelens.streaming import stateful as K
from pagelens.streaming.run import drain

LEVEL_SQL = "case event_type when 'error' then 'error' when 'purchase' then 'warning' else 'info' end"
SHAPE_SQL = r"regexp_replace(event_type || ' ' || props, '\b[0-9]+\b', '#', 'g')"
KIND_SQL = "case event_type when 'view' then 'navigation' when 'purchase' then 'download' else 'action' end"


def events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events")


def console(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.expr(LEVEL_SQL).alias("level"), F.concat_ws(" ", "event_type", "props").alias("text"))


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as a stream of files."""
    return spark.readStream.schema(events(spark, d).schema).parquet(f"{d}/events.[p]arquet")


def calls(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return (events(spark, d) if rows is None else rows).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "ts", F.expr(KIND_SQL).alias("kind"), F.concat(F.lit("https://"), F.col("props").substr(7, 1), F.lit(".example.com")).alias("origin"), F.col("event_type").alias("sig"))


@query(
    "g1_list_requests",
    """with r as (select event_id as id, 'https://' || event_type || '.example.com/' || user_id as url, event_type as resource_type from events),
    m as (select * from r where contains(url, 'click')) select id, url, (select count(*) from r) as recorded, (select count(*) from m) as matched, 0::bigint as analytics_hidden from m order by id limit 40""",
)
def g1_list_requests(spark: SparkSession, d: str) -> DataFrame:
    r = events(spark, d).select(F.col("event_id").alias("id"), F.concat(F.lit("https://"), "event_type", F.lit(".example.com/"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("resource_type"))
    return G.list_requests(r, contains="click").select("id", "url", "recorded", "matched", "analytics_hidden")


@query(
    "g5_console_shapes",
    f"with s as (select {LEVEL_SQL} as level, {SHAPE_SQL} as shape, event_id, event_type || ' ' || props as text from events), g as (select level, shape, count(*) as n, arg_min(text, event_id) as sample from s group by all) select *, (select sum(n) from g)::bigint as lines_at_level, (select count(*) from g) as unique_shapes from g",
)
def g5_console_shapes(spark: SparkSession, d: str) -> DataFrame:
    return G.console_shapes(console(spark, d), level="debug").select("level", "shape", "n", "sample", "lines_at_level", "unique_shapes")


@query("g6_page_errors", "select seq, text from (select event_id as seq, event_type || ' ' || props as text from events where event_type = 'error' order by event_id desc limit 20)")
def g6_page_errors(spark: SparkSession, d: str) -> DataFrame:
    return G.newest(console(spark, d).where("level = 'error'")).select("seq", "text")


@query("g7_read_audit", "select seq, tool, pos, total from (select event_id as seq, event_type as tool, row_number() over (order by event_id) - 1 as pos, count(*) over () as total from events where event_type = 'click') where pos >= 40 and pos < 80")
def g7_read_audit(spark: SparkSession, d: str) -> DataFrame:
    audit = events(spark, d).select(F.col("event_id").alias("seq"), F.col("event_type").alias("tool"))
    return G.audit_page(audit, tool="click", start=40, limit=40).select("seq", "tool", F.col("pos").cast("long").alias("pos"), "total")


@query("g8_scrub_args", "select event_id, 'len=' || length(props) || ' sha256=' || left(sha256(props), 8) as secret, event_type as plain from events")
def g8_scrub_args(spark: SparkSession, d: str) -> DataFrame:
    args = G.scrub_args(F.create_map(F.lit("value"), "props", F.lit("name"), "event_type"))
    return events(spark, d).select("event_id", args["value"].alias("secret"), args["name"].alias("plain"))


@query("g9_redact_secrets", "select event_id, replace(replace(props, '69', '[masked]'), '7', '[masked]') as props from events")
def g9_redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", G.redact_secrets(F.col("props"), ["7", "69"]).alias("props"))


BUDGET_SQL = f"""with recursive c as (select user_id as session, event_id as seq, {KIND_SQL} as kind, 'https://' || substr(props, 7, 1) || '.example.com' as origin, row_number() over (partition by user_id order by event_id) as rn from events),
    f as (
      select session, seq, rn, null::varchar as refused, 1 as a, (kind = 'navigation')::int as n, (kind = 'download')::int as w, [origin] as o from c where rn = 1
      union all
      select session, seq, rn, r, a + (r is null)::int, n + (r is null and kind = 'navigation')::int, w + (r is null and kind = 'download')::int, case when r is null and not list_contains(o, origin) then list_append(o, origin) else o end
      from (select c.*, f.a, f.n, f.w, f.o, case when f.a >= 25 then 'action' when c.kind = 'navigation' and f.n >= 6 then 'navigation' when c.kind = 'download' and f.w >= 4 then 'download' when not list_contains(f.o, c.origin) and len(f.o) >= 7 then 'new_origin' end as r from f join c on c.session = f.session and c.rn = f.rn + 1)
    ) select session, seq, refused from f"""


@query("g16_charge_budget", BUDGET_SQL)
def g16_charge_budget(spark: SparkSession, d: str) -> DataFrame:
    """Wall clock is left out here by a limit beyond the month of the events."""
    rows = calls(spark, d).withColumn("ts", F.lit(0.0))
    return G.charge_budget(rows, {"action": 25, "navigation": 6, "download": 4, "new_origin": 7})


@query(
    "g16_wall_clock",
    "select user_id as session, event_id as seq, case when epoch(ts) - first_value(epoch(ts)) over (partition by user_id order by event_id) > 259200 then 'wall_clock' end as refused from events",
)
def g16_wall_clock(spark: SparkSession, d: str) -> DataFrame:
    rows = calls(spark, d).withColumn("origin", F.lit(None).cast("string"))
    return G.charge_budget(rows, {k: 1 << 40 for k in G.LIMITS}, wall_clock=259_200)


@query("g17_budget_snapshot", f"select user_id as session, count(*) as n_calls, count(*) filter ({KIND_SQL} = 'navigation') as n_navigation, count(*) filter ({KIND_SQL} = 'download') as n_download, count(distinct substr(props, 7, 1)) as origins from events group by 1")
def g17_budget_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return G.budget_snapshot(calls(spark, d)).drop("wall_s")


LOOP_SQL = """with w as (select user_id as session, event_id as seq, event_type as sig, list(event_type) over (partition by user_id order by event_id rows between 19 preceding and current row) as r from events)
    select session, seq, case when len(list_filter(r, lambda x: x = sig)) >= 5 then 'repeat' when len(r) >= 8 and len(list_distinct([r[-1], r[-3], r[-5], r[-7]])) = 1 and len(list_distinct([r[-2], r[-4], r[-6], r[-8]])) = 1 and r[-1] <> r[-2] then 'alternation' end as loop from w"""


@query("g18_loop_detect", LOOP_SQL)
def g18_loop_detect(spark: SparkSession, d: str) -> DataFrame:
    return G.loop_detect(calls(spark, d)).select("session", "seq", "loop")


@query(
    "g19_parse_retry_after",
    """select event_id, case event_id % 4 when 0 then least(greatest(value, 0.0), 86400.0) when 1 then 0.0 when 2 then least(user_id * 1000.0, 86400.0) end as wait from events""",
)
def g19_parse_retry_after(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("now", F.date_trunc("second", F.col("ts").cast("timestamp")))
    later = F.timestamp_seconds(F.unix_seconds(F.col("now").cast("timestamp")) + F.col("user_id") * 1000)
    date = F.concat(F.lit("Mon, "), F.date_format(later, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    raw = F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")).when(F.col("event_id") % 4 == 1, F.lit("-5")).when(F.col("event_id") % 4 == 2, date).otherwise("soon")
    return e.select("event_id", G.parse_retry_after(raw, F.col("now")).alias("wait"))


BACKOFF_SQL = """with r as (select user_id as domain, event_id as seq, epoch(ts) as t, case event_type when 'error' then 429 when 'signup' then 503 else 200 end as status, case event_id % 3 when 1 then 0.0 when 2 then user_id * 600.0 end as wait from events),
    o as (select *, case when status in (429, 503) and coalesce(wait, 60.0) > 0 then t + coalesce(wait, 60.0) end as until from r),
    m as (select *, max(until) over (partition by domain order by t, seq rows between unbounded preceding and 1 preceding) as open from o) select domain, seq, coalesce(open > t, false) as refused from m"""


def responses(rows: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "signup", 503).otherwise(200)
    wait = F.when(F.col("event_id") % 3 == 1, 0.0).when(F.col("event_id") % 3 == 2, F.col("user_id") * 600.0)
    return rows.select(F.col("user_id").alias("domain"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), wait.alias("wait"))


@query("g20_backoff_windows", BACKOFF_SQL)
def g20_backoff_windows(spark: SparkSession, d: str) -> DataFrame:
    return G.backoff_windows(responses(events(spark, d))).select("domain", "seq", "refused")


@query("j9_backoff_stream", BACKOFF_SQL)
def j9_backoff_stream(spark: SparkSession, d: str) -> DataFrame:
    """Nothing is late: the files of a folder make one batch."""
    return drain(K.backoff_stream(responses(event_stream(spark, d)))).select("domain", "seq", "refused")


@query("j9_loop_stream", LOOP_SQL)
def j9_loop_stream(spark: SparkSession, d: str) -> DataFrame:
    return drain(K.loop_detect_stream(calls(spark, d, event_stream(spark, d)))).select("session", "seq", "loop")


@query("j9_budget_stream", BUDGET_SQL)
def j9_budget_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = calls(spark, d, event_stream(spark, d)).withColumn("ts", F.lit(0.0))
    return drain(K.charge_calls_stream(rows, {"action": 25, "navigation": 6, "download": 4, "new_origin": 7}))


@query(
    "g14_parameters",
    """with p(param, declared, given) as (values ('k', 'k', 'KEY'), ('host', 'shop', 'evil'), ('num', '1', '77')),
    s as (select user_id as session, event_id as number, a.arg, a.value from (select *, unnest([{'arg': 'props', 'value': props}, {'arg': 'url', 'value': 'https://shop.example.com/k/1/k' || event_id}]) as a from events)),
    j as (select session, number, arg, param, value, replace(value, declared, given) as filled from s join p on contains(s.value, p.declared))
    select session, number, arg, param, case when arg = 'url' and param = 'host' then value else filled end as value, arg = 'url' and param = 'host' as refused from j""",
)
def g14_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Every place of each declared value is filled; another host is refused."""
    url = F.concat(F.lit("https://shop.example.com/k/1/k"), F.col("event_id").cast("string"))
    steps = events(spark, d).select(F.col("user_id").alias("session"), F.col("event_id").alias("number"), F.create_map(F.lit("props"), "props", F.lit("url"), url).alias("args"))
    rows = spark.createDataFrame([("k", "k", "KEY"), ("host", "shop", "evil"), ("num", "1", "77")], "param string, declared string, given string")
    return G.apply_parameters(G.bind_parameters(steps, rows.select("param", "declared")), rows.select("param", "given"))
