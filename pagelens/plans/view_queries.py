"""Registered queries on articles, budgeted views and scalar classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators import article as A
from pagelens.operators import classify as C
from pagelens.operators import view as V
from pagelens.operators.nodes import parsed_once
from pagelens.plans.log_queries import events
from pagelens.plans.markup_queries import spread
from pagelens.plans.page_queries import BLOCKS_SQL, pages
from pagelens.plans.registry import query
from pagelens.sources.pages import read_table

ARTICLE_SQL = f"""{BLOCKS_SQL},
edge as (select page_id, max(i) filter (opener = 'article') as a, max(i) filter (opener = '/article') as z from cells group by 1),
inside as (select b.*, e.a, e.z from blocks b join edge e using (page_id) where text <> ''),
kind as (select page_id, bool_or(i > a and i < z and opener in ('p', 'br') and length(text) >= 25) as art, bool_or(opener = 'div' and length(text) >= 25) as ad from inside group by 1)"""


@query(
    "c17_article_blocks",
    f"with {ARTICLE_SQL} select page_id, row_number() over (partition by page_id order by i) as pos, text from inside join kind using (page_id) where case when art then i >= a and i < z when ad then true else false end",
)
def c17_article_blocks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = parsed_once(pages(spark, d))
    return A.article_blocks(n, A.article_body(n)).select("page_id", F.row_number().over(W.partitionBy("page_id").orderBy("start")).cast("long").alias("pos"), "text")


@query(
    "c18_article_excluded",
    f"with {ARTICLE_SQL} select page_id, case when opener = 'a' or opener in ('nav', 'ul', 'li') then 'nav' when i > z then 'footer' else 'promo' end as reason, count(*) as blocks, sum(length(text))::bigint as chars from inside join kind using (page_id) where case when art then not (i >= a and i < z) when ad then false else true end group by all",
)
def c18_article_excluded(spark: SparkSession, d: str) -> DataFrame:
    n = parsed_once(pages(spark, d))
    return A.article_excluded(n, A.article_body(n))


@query("c19_article_meta", f"with {BLOCKS_SQL} select page_id, text as title, 'body-h1' as title_source from blocks where opener = 'h1' and text <> ''")
def c19_article_meta(spark: SparkSession, d: str) -> DataFrame:
    return A.article_meta(parsed_once(pages(spark, d))).select("page_id", "title", "title_source")


UNIT_SQL = "case event_type when 'view' then 'nav' when 'click' then 'form_control' when 'purchase' then 'primary' when 'signup' then 'other' else 'prose_link' end"


@query(
    "e3_select_by_quota",
    f"""with u as (select user_id as page_id, event_id as node_id, {UNIT_SQL} as cls, value as score from events), q as (select * from (values ('nav', 3), ('form_control', 5), ('primary', 2), ('other', 1), ('prose_link', 0)) v(cls, cap)),
    r as (select u.*, cap, row_number() over (partition by page_id, u.cls order by score desc, node_id) as n, count(*) over (partition by page_id, u.cls) as cls_total from u join q using (cls)) select page_id, node_id, cls, greatest(cls_total - cap, 0) as suppressed from r where n <= cap""",
)
def e3_select_by_quota(spark: SparkSession, d: str) -> DataFrame:
    u = events(spark, d).select(F.col("user_id").alias("page_id"), F.col("event_id").alias("node_id"), F.expr(UNIT_SQL).alias("cls"), F.col("value").alias("score"))
    return V.select_by_quota(u, {"nav": 3, "form_control": 5, "primary": 2, "other": 1, "prose_link": 0}).select("page_id", "node_id", "cls", F.col("suppressed").cast("long").alias("suppressed"))


RUNG_SQL = ", ".join(f"({r[0]}, '{u}', {'null' if c is None else c})" for r in V.RUNGS for u, c in zip(("region", "nav", "form_control", "primary", "other", "lead", "heading", "field", "next_call", "form"), r[1:]))


@query(
    "e4_budget_ladder",
    f"""with rungs(rung, unit, cap) as (values {RUNG_SQL}),
    u as (select user_id as page_id, {UNIT_SQL.replace("'prose_link'", "'heading'")} as unit, event_id as pos, 30 + event_id % 50 as tokens from events),
    s as (select *, row_number() over (partition by page_id, unit order by pos) as n from u),
    t as (select page_id, rung, sum(case when cap is null or n <= cap then tokens else 0 end)::bigint as total from s join rungs using (unit) group by all),
    w as (select *, min(total) over (partition by page_id order by rung rows between unbounded preceding and 1 preceding) as before from t)
    select page_id, min(rung) filter (total <= 2250 and (before is null or total <= before)) as rung, arg_min(total, rung) filter (total <= 2250 and (before is null or total <= before)) as tokens, min(total) as floor from w group by 1""",
)
def e4_budget_ladder(spark: SparkSession, d: str) -> DataFrame:
    u = events(spark, d).select(F.col("user_id").alias("page_id"), F.expr(UNIT_SQL.replace("'prose_link'", "'heading'")).alias("unit"), F.col("event_id").alias("pos"), (30 + F.col("event_id") % 50).alias("tokens"))
    return V.budget_ladder(u, 2500)


@query(
    "e8_pack_parts",
    """with recursive p as (select user_id as owner, event_id, 1 + event_id % 60 as tokens, row_number() over (partition by user_id order by event_id) as rn from events),
    f as (select owner, rn, case when tokens <= 400 then tokens else 0 end as total, case when tokens <= 400 then 1 else 0 end as kept from p where rn = 1
    union all select p.owner, p.rn, f.total + case when f.total + p.tokens <= 400 then p.tokens else 0 end, f.kept + (f.total + p.tokens <= 400)::int from f join p on p.owner = f.owner and p.rn = f.rn + 1)
    select owner, total as tokens, kept from (select *, row_number() over (partition by owner order by rn desc) as k from f) where k = 1""",
)
def e8_pack_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = events(spark, d).select(F.col("user_id").alias("owner"), F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("name"), (1 + F.col("event_id") % 60).alias("tokens"))
    return V.pack_parts(parts).select("owner", "tokens", F.size(F.split("kept", ",")).alias("kept"))


@query(
    "c5_fit_columns",
    """with per as (select l_orderkey % 50 as table_id, l_linenumber as col_ix, sum(ceil(l_quantity / 3.7::double))::bigint as t from lineitem group by all),
    s as (select *, row_number() over (partition by table_id order by col_ix) as n, sum(t) over (partition by table_id order by col_ix) as cost, count(*) over (partition by table_id) as total from per),
    k as (select *, list_contains([total, total // 2, total // 4, total // 8, 1], n) as tried from s)
    select table_id, max(total) as total, coalesce(max(n) filter (tried and cost <= 400), 1) as kept from k group by 1""",
)
def c5_fit_columns(spark: SparkSession, d: str) -> DataFrame:
    cells = read_table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("table_id"), F.col("l_linenumber").alias("col_ix"), F.ceil(F.col("l_quantity") / F.lit(3.7)).cast("long").alias("tokens"))
    return V.fit_columns(cells, 400).select("table_id", "total", F.col("kept").cast("long").alias("kept"))


@query("h11_has_amount", r"select doc_id, regexp_matches(text, '[$€£¥]\s?[0-9]|[0-9]\s?([$€£¥]|(USD|EUR|GBP)\b)|\b(USD|EUR|GBP)\s?[0-9]') as has_amount from documents")
def h11_has_amount(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", C.has_amount(F.col("text")).alias("has_amount"))


@query("h12_pan_shape", "with c as (select c_custkey, '4111 1111-' || (c_custkey * 1000003)::varchar as v from customer) select c_custkey, length(v) between 13 and 32 and length(regexp_replace(v, '[^0-9]', '', 'g')) between 13 and 19 as pan from c")
def h12_pan_shape(spark: SparkSession, d: str) -> DataFrame:
    value = F.concat(F.lit("4111 1111-"), (F.col("c_custkey") * 1000003).cast("string"))
    return read_table(spark, d, "customer").select("c_custkey", C.pan_shape(value).alias("pan"))


@query(
    "h1_classify",
    """with r as (select event_id, case event_type when 'error' then 503 when 'signup' then 404 when 'purchase' then 429 when 'click' then 401 else 200 end as status from events)
    select event_id, unnest(case status when 503 then ['maintenance'] when 404 then ['http_404'] when 429 then ['rate_limited'] when 401 then ['login_required'] else ['insufficient_evidence'] end) as label, case when status = 503 then 'possible' when status = 200 then 'insufficient_evidence' else 'confirmed' end as confidence from r""",
)
def h1_classify(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 404).when(F.col("event_type") == "purchase", 429).when(F.col("event_type") == "click", 401).otherwise(200)
    r = events(spark, d).select("event_id", F.lit("https://a.example.com/x").alias("url"), F.lit("https://a.example.com/x").alias("landed_url"), status.alias("status"), F.create_map().cast("map<string,string>").alias("headers"), F.lit("").alias("title"), F.lit("hello").alias("body"), F.lit("").alias("source"))
    return C.classify_response(r).select("event_id", "label", "confidence")


RESPONSES_SQL = "case event_type when 'click' then 'cf-mitigated' when 'view' then 'x-dd-b' when 'error' then 'server' else 'x-none' end"


def blocked(spark: SparkSession, d: str) -> DataFrame:
    """Responses with a block header, an edge server, a block page, or none, by the kind of event."""
    name = F.expr(RESPONSES_SQL)
    value = F.expr("case event_type when 'error' then 'AkamaiGHost' else 'x' end")
    body = F.expr("case event_type when 'signup' then 'Press & Hold to confirm' else 'a page of plain words' end")
    url = F.lit("https://a.example.com/x")
    status = F.expr("case event_type when 'signup' then 403 else 200 end")
    long = F.repeat(F.lit("readable words "), F.lit(20))
    return spread(events(spark, d), "event_id").select("event_id", url.alias("url"), url.alias("landed_url"), status.alias("status"), F.create_map(name, value).alias("headers"), F.lit("").alias("title"), F.concat(body, F.lit(" "), long).alias("body"), F.lit("").alias("source"))


@query("h4_vendors", "select event_id, case event_type when 'click' then 'Cloudflare' when 'view' then 'DataDome' when 'error' then 'Akamai' when 'signup' then 'HUMAN (PerimeterX)' else '' end as vendors, case event_type when 'click' then 'Cloudflare' when 'view' then 'DataDome' end as decides from events")
def h4_vendors(spark: SparkSession, d: str) -> DataFrame:
    return blocked(spark, d).select("event_id", F.array_join(C.all_vendors(), ",").alias("vendors"), C.header_block().alias("decides"))


@query("h3_wall_for", "select event_id, 'botwall' as wall from events where event_type in ('click', 'view', 'signup')")
def h3_wall_for(spark: SparkSession, d: str) -> DataFrame:
    return C.wall_for(C.classify_response(blocked(spark, d)), "event_id").select("event_id", "wall")
