"""Queries on rotated logs, series of pages, threads, form classes, monitors and the ledger of a read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators import article as A
from pagelens.operators import classify as C
from pagelens.operators import links as L
from pagelens.operators import monitor as M
from pagelens.operators import tables as B
from pagelens.operators import view as V
from pagelens.operators.nodes import parsed_once
from pagelens.plans.log_queries import events
from pagelens.plans.markup_queries import spread
from pagelens.plans.registry import query
from pagelens.session import shared_dir, stored
from pagelens.sources.audit import AuditLog
from pagelens.sources.pages import read_table

AUDIT_KEEP = 1500


@query(
    "a4_rotate_audit",
    f"""with e as (select event_id, event_type, event_id * 3 // (select max(event_id) + 1 from events) as b from events),
    c as (select count(*) filter (b = 0) as b0, count(*) filter (b = 1) as b1, count(*) filter (b = 2) as b2, count(*) as total from e),
    n0 as (select *, case when b0 > {2 * AUDIT_KEEP} then {AUDIT_KEEP} else b0 end as n0 from c), n1 as (select *, case when n0 + b1 > {2 * AUDIT_KEEP} then {AUDIT_KEEP} else n0 + b1 end as n1 from n0),
    n2 as (select *, case when n1 + b2 > {2 * AUDIT_KEEP} then {AUDIT_KEEP} else n1 + b2 end as n2 from n1)
    select seq, tool, dropped from (select event_id as seq, event_type as tool, total - n2 as dropped, n2, row_number() over (order by event_id desc) as age from e, n2) where age <= n2""",
)
def a4_rotate_audit(spark: SparkSession, d: str) -> DataFrame:
    """Three appends, each with a rotation after it."""
    log = AuditLog(spark, f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}")
    e = events(spark, d)
    last = e.agg(F.max("event_id")).first()[0]
    for part in range(3):
        rows = e.where(F.floor(F.col("event_id") * 3 / (last + 1)) == part)
        log.append(rows.select(F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), F.create_map(F.lit("props"), "props").alias("args")))
        receipt = log.rotate(AUDIT_KEEP)
    return log.read().select("seq", "tool", F.lit(receipt["dropped"]).cast("long").alias("dropped"))


ORDER_PAGES = """select 'https://shop.example.com/o/' || o_orderkey as url, o_orderkey as k,
    coalesce('https://shop.example.com/o/' || lead(o_orderkey) over (partition by o_custkey order by o_orderkey), case o_custkey % 3 when 0 then 'https://shop.example.com/o/' || min(o_orderkey) over (partition by o_custkey) when 1 then 'ftp://shop.example.com/more' end) as next_url,
    repeat(o_orderpriority || '. ', cast(1 + o_orderkey % 40 as int)) as text from orders"""
SERIES_STEP = """select series, url, step, seen, unread is null as read, chars, unread is null and len > 300 as clipped, onward,
    case when unread is not null then unread when step = 12 then 'page-cap' when chars >= 1200 then 'char-budget' when onward is null then 'end' when list_contains(seen, onward) then 'loop' end as stop
    from (select *, chars0 + case when unread is null then least(len, 300) else 0 end as chars, case when next_url like 'http%' then next_url end as onward from (
    select x.*, p.next_url, length(p.text) as len, case when step > 1 and p.k % 31 = 0 then 'navigation-failed' when p.url is null then 'end-of-corpus' when step > 1 and p.k % 23 = 0 and length(p.text) < 200 then 'wall' when p.k % 29 = 0 then 'unreadable-resource' end as unread from x left join p on p.url = x.url))"""


@query(
    "c24_read_series",
    f"""with recursive o as ({ORDER_PAGES}), p as (select * from o where k % 37 <> 0),
    first as (select 'https://shop.example.com/o/' || min(o_orderkey) as url from orders group by o_custkey),
    w as (with x as (select url as series, url, 1 as step, [url] as seen, 0::bigint as chars0 from first) {SERIES_STEP}
    union all (with x as (select series, onward as url, step + 1 as step, list_append(seen, onward) as seen, chars as chars0 from w where stop is null) {SERIES_STEP}))
    select series, step, url, read, chars, coalesce(clipped, false) as clipped, stop, case when stop in ('page-cap', 'char-budget') then onward when stop = 'navigation-failed' then url end as resume from w""",
)
def c24_read_series(spark: SparkSession, d: str) -> DataFrame:
    """The orders of each customer as a series; walls and kinds come from the classifier of responses and that of resources."""
    read_table(spark, d, "orders").createOrReplaceTempView("series_orders")
    pages = stored(spark.sql(ORDER_PAGES.replace("from orders", "from series_orders")))
    spark.catalog.dropTempView("series_orders")
    walled, odd = F.col("k") % 23 == 0, F.col("k") % 29 == 0
    answers = pages.where(walled).select("url", F.col("url").alias("landed_url"), F.lit(200).alias("status"), F.create_map().cast("map<string,string>").alias("headers"), F.lit("Just a moment...").alias("title"), F.col("text").alias("body"), F.lit("").alias("source"))
    walls = C.wall_for(C.classify_response(answers), "url")
    kinds = L.resource_kind(pages.select("url", F.when(odd, "application/pdf").otherwise("text/html").alias("content_type"), F.lit(500).alias("readable_chars"))).select("url", F.col("kind").alias("resource"))
    chain = pages.where("k % 37 <> 0").join(walls, "url", "left").join(kinds, "url", "left").withColumn("failed", F.col("k") % 31 == 0)
    start = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k")).select(F.concat(F.lit("https://shop.example.com/o/"), F.col("k").cast("string")).alias("url"))
    return L.read_series(start, chain, max_pages=12, max_chars=300, budget_chars=1200)


TURN = """'<div class="post"><span class="' || case turn % 3 when 0 then 'author' when 1 then 'post-username' else 'quiet' end || '">' || role || '</span><time datetime="2024-01-01T00:00:0' || cast(turn as varchar(9)) || 'Z">turn ' || cast(turn as varchar(9)) || '</time><blockquote>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</blockquote></div>'"""


def discussions(spark: SparkSession, d: str) -> DataFrame:
    """``page_id, html``: a page per conversation, its turns as posts in a list, with a time in the navigation."""
    turns = spread(read_table(spark, d, "conversations"), "conv_id").select("conv_id", F.struct("turn", F.expr(TURN).alias("post")).alias("t"))
    posts = turns.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list("t"))["post"], "").alias("posts"))
    return posts.select(F.col("conv_id").alias("page_id"), F.concat(F.lit('<html><body><nav><time datetime="2020">then</time></nav><div class="list">'), "posts", F.lit("</div></body></html>")).alias("html"))


@query(
    "c21_threads",
    r"""with t as (select conv_id, turn, role, trim(regexp_replace(role || 'turn ' || turn || text, '[\s\x{00a0}]+', ' ', 'g')) as body from conversations),
    s as (select *, count(*) over w as n_posts, sum(length(body)) over w as chars from t window w as (partition by conv_id))
    select conv_id as page_id, row_number() over (partition by conv_id order by turn) as post, case when turn % 3 < 2 then role end as author, '2024-01-01T00:00:0' || turn || 'Z' as at, 'turn ' || turn as at_text,
    case when length(body) > 1200 then body[:1200] || '...' else body end as text, n_posts from s where n_posts >= 3 and chars >= 200""",
)
def c21_threads(spark: SparkSession, d: str) -> DataFrame:
    return A.threads(parsed_once(discussions(spark, d))).select("page_id", F.col("post").cast("long").alias("post"), "author", "at", "at_text", "text", "n_posts")


#: Submitters with the terms that they hold: payment, destructive, assent, broadcast, send, confirm, search, amount.
SUBMITTERS = (
    ("Kündigen", None, "kundigen", None, None, None, None, None, False), ("今すぐ購入", "購入", None, None, None, None, None, None, False), ("Envoyer", None, None, None, None, "envoyer", None, None, False),
    ("ＰＡＹ ＮＯＷ", "pay", None, None, None, None, None, None, False), ("Search", None, None, None, None, None, None, "search", False), (None, None, None, None, None, None, None, None, False),
    ("jetztLöschen", None, "loschen", None, None, None, None, None, False), ("Continue $5", None, None, None, None, None, "continue", None, True), ("Veröffentlichen", None, None, None, "veroffentlichen", None, None, None, False),
    ("I agree", None, None, "i agree", None, None, None, None, False), ("Paying", None, None, None, None, None, None, None, False), ("회원탈퇴신청", None, "탈퇴", None, None, None, None, None, False), ("Accepté", None, None, None, None, None, None, None, False),
)
#: Actions: payment, destructive, broadcast, payment path, search.
ACTIONS = (
    ("/checkout/search", "checkout", None, None, "checkout", "search"), ("https://pay.example.com/go", None, None, None, None, None), ("/account/delete?pay=1#buy", None, "delete", None, None, None),
    ("/thread/42/reply", None, None, "reply", None, None), (None, None, None, None, None, None), ("https://pay.example.com", None, None, None, None, None), ("/orders/new", None, None, None, "orders", None),
)
LABELS = ((None, None), ("I have read the Terms", "terms"), ("Newsletter", None), ("利用規約に同意する", "利用規約"))
literal = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"
table_of = lambda rows: ", ".join(f"({k}, {', '.join(map(literal, r))})" for k, r in enumerate(rows))
CENSUS = f"p_partkey % 5 = 0 and p_partkey % 3 = 0 as payment, p_partkey % 7 = 3 as secret, p_partkey % 4 = 1 as textarea, p_partkey % 6 = 2 as recipient, case when p_partkey % 2 = 0 then 'GET' else 'POST' end as method, cast(1 + p_partkey % 3 as int) as field_count, p_partkey % {len(SUBMITTERS)} as si, p_partkey // {len(SUBMITTERS)} % {len(ACTIONS)} as ai, p_partkey % {len(LABELS)} as li"


@query(
    "h9_classify_submission",
    f"""with s(si, submitter, pay, destroy, assent, strong, send, confirm, search, amount) as (values {table_of(SUBMITTERS)}), a(ai, action, apay, adestroy, astrong, apath, asearch) as (values {table_of(ACTIONS)}), l(li, labels, lassent) as (values {table_of(LABELS)}),
    c as (select p_partkey, {CENSUS} from part), j as (select *, method = 'GET' and field_count = 1 and not payment and not secret and coalesce(asearch, search) is not null as searches from c join s using (si) join a using (ai) join l using (li)),
    r as (select p_partkey, searches, case when payment then ['payment', 'field', null] when pay is not null then ['payment', 'words', pay] when apay is not null and not searches then ['payment', 'words', apay] when amount and coalesce(confirm, apath) is not null then ['payment', 'amount', coalesce(confirm, apath)]
    when secret then ['credential', 'field', null] when coalesce(destroy, adestroy) is not null then ['destructive', 'words', coalesce(destroy, adestroy)] when submitter is not null and lassent is not null then ['legal', 'checkbox', lassent] when assent is not null then ['legal', 'words', assent]
    when coalesce(strong, astrong) is not null then ['broadcast', 'words', coalesce(strong, astrong)] when textarea and recipient then ['broadcast', 'recipient', null] when (textarea or recipient) and send is not null then ['broadcast', 'send', send] else ['none', null, null] end as v from j)
    select p_partkey, v[1] as cls, v[2] as reason, v[3] as term, searches as search_shaped from r""",
)
def h9_classify_submission(spark: SparkSession, d: str) -> DataFrame:
    """Forms in several scripts: diacritics, full width, camel case, terms without blanks, hosts that say what the path does not."""
    parts = spread(read_table(spark, d, "part"), "p_partkey").selectExpr("p_partkey", *CENSUS.replace(f"p_partkey // {len(SUBMITTERS)} %", f"p_partkey div {len(SUBMITTERS)} %").split(", "))
    pick = lambda rows, k: F.get(F.array(*(F.lit(r[0]).cast("string") for r in rows)), F.col(k).cast("int"))
    census = parts.select("*", pick(SUBMITTERS, "si").alias("submitter"), pick(ACTIONS, "ai").alias("action"), pick(LABELS, "li").alias("checkbox_labels"))
    return C.search_shaped(C.classify_submission(census)).select("p_partkey", "cls", "reason", "term", "search_shaped")


@query(
    "j1_observe",
    r"""with p as (select 'u' || doc_id as url, doc_id, text from documents),
    v as (select doc_id, unnest(['hash', 'count', 'appears']) as condition, text from p)
    select doc_id as monitor_id, condition, case condition when 'hash' then sha256(trim(regexp_replace(nfc_normalize(text), '[\s\x{00a0}]+', ' ', 'g'))) when 'count' then len(regexp_extract_all(text, '[aeiou]n'))::varchar else contains(text, 'the')::varchar end as value, text is not null as ok from v""",
)
def j1_observe(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), "text")
    needles = F.explode(F.array(*(F.struct(F.lit(c).alias("condition"), F.lit(n).alias("needle")) for c, n in (("hash", ""), ("count", "[aeiou]n"), ("appears", "the")))))
    monitors = docs.select(F.col("doc_id").alias("monitor_id"), "url", needles.alias("m")).select("monitor_id", "url", "m.*")
    return M.observe(docs.select("url", "text", F.lit(0).alias("observed_at")), monitors).select("monitor_id", "condition", "value", "ok")


LEDGER_CAPS, LEDGER_QUOTAS, LEDGER_FIELDS = {"region": 6, "affordance": 3, "form": 3, "heading": 2, "field": None}, {"c0": 3, "c1": 2}, 2
LEDGER_UNITS = "user_id as page_id, case event_type when 'view' then 'affordance' when 'click' then 'region' when 'purchase' then 'form' when 'signup' then 'field' else 'heading' end as kind, event_id as node_id, 'c' || cast(k % 3 as varchar(3)) as cls, k as pos, event_id % 11 <> 0 as reached, k % 4 <> 0 as owns, k % 8 = 0 as has_children, k % 5 = 0 as expanded, case when event_type = 'signup' then max(case when event_type = 'purchase' then event_id end) over (partition by user_id order by event_id) end as form_id"


@query(
    "e7_completeness",
    f"""with u as (select {LEDGER_UNITS} from (select *, cast(regexp_extract(props, '[0-9]+') as int) as k from events)),
    s0 as (select *, case when not reached then 'not_reached' when kind = 'region' and not owns then case when has_children then 'listed_container_only' else 'no_content' end end as s0 from u),
    s1 as (select *, coalesce(s0, case when kind = 'affordance' and row_number() over (partition by page_id, kind, cls, s0 is null order by pos, node_id) > case cls when 'c0' then 3 when 'c1' then 2 else 0 end then 'suppressed_by_quota' end) as s1 from s0),
    s2 as (select *, coalesce(s1, case when row_number() over (partition by page_id, kind, s1 is null order by pos, node_id) > case kind when 'region' then 6 when 'affordance' then 3 when 'form' then 3 when 'heading' then 2 else 1000000000 end then 'dropped_by_rung' end) as s2 from s1),
    s3 as (select s2.* replace (coalesce(s2.s2, case when s2.kind = 'field' and f.s2 is not null then 'dropped_by_rung' end) as s2) from s2 left join s2 f on f.page_id = s2.page_id and f.kind = 'form' and f.node_id = s2.form_id),
    s4 as (select *, coalesce(s2, case when kind = 'region' and not expanded then 'listed_not_expanded' when kind = 'field' and row_number() over (partition by page_id, form_id, kind, s2 is null order by pos, node_id) > 2 then 'summarized' else 'printed' end) as status from s3)
    select page_id, kind, status, cls, count(*) as n, case when grouping(kind) = 1 then 'page' when grouping(status) = 1 then 'kind' when grouping(cls) = 1 then 'status' else 'class' end as level from s4 group by grouping sets ((page_id, kind, status, cls), (page_id, kind, status), (page_id, kind), (page_id))""",
)
def e7_completeness(spark: SparkSession, d: str) -> DataFrame:
    """What became of every unit, in all eight statuses, with the sums on each level."""
    units = events(spark, d).withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    units = units.select(*(F.expr(c) for c in split_columns(LEDGER_UNITS)))
    return V.completeness(V.unit_ledger(units, LEDGER_CAPS, LEDGER_QUOTAS, LEDGER_FIELDS))


def split_columns(text: str) -> list[str]:
    """The columns of a select list, parted at commas outside brackets."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


PART_ROWS = """case p_partkey % 4 when 0 then '<table><tr><td rowspan="2">' || cast(p_partkey as varchar(20)) || '</td><td>a</td></tr><tr><td>b</td></tr><tr></tr><tr><td>c</td></tr></table>'
    when 1 then '<table><tfoot><tr><td>foot</td></tr></tfoot><tbody><tr><th>head</th></tr><tr><td colspan="2">' || p_brand || '</td></tr></tbody></table>'
    when 2 then '<table><tr><td><div>menu</div></td></tr></table><table role="presentation"><tr><td>x</td></tr></table><div role="grid" aria-label="Grid"><div role="row"><span role="columnheader">h</span></div><div role="row"><span role="gridcell">' || p_brand || '</span></div></div>'
    else '<table><caption>One</caption><tr><th>a</th></tr></table><table><caption>Two</caption><tr><td>1</td><td>2</td></tr></table>' end"""


@query(
    "c4_table_choice",
    """select p_partkey as page_id, case p_partkey % 4 when 3 then 'ambiguous' end as refused, case p_partkey % 4 when 3 then 'table:One:1|table:Two:1' end as choices,
    case p_partkey % 4 when 0 then p_partkey || ',a/' || p_partkey || ',b/c,' when 1 then p_brand || ',' || p_brand || '/foot,' when 2 then p_brand end as data, case p_partkey % 4 when 0 then 4 when 1 then 2 when 2 then 1 end::bigint as total_rows from part""",
)
def c4_table_choice(spark: SparkSession, d: str) -> DataFrame:
    """Row spans, empty rows, a foot before the body, layout tables, roles in place of tags, and two tables to choose from."""
    pages = spread(read_table(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("<html><body>"), F.expr(PART_ROWS), F.lit("</body></html>")).alias("html"))
    nodes = parsed_once(pages)
    inventory = stored(B.table_inventory(nodes))
    choice = B.table_choice(inventory)
    data = B.get_table(B.table_cells(nodes, inventory), choice=choice)
    lines = data.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("row", F.array_join("cells", ",").alias("line"))))["line"], "/").alias("data"), F.max("total_rows").alias("total_rows"))
    told = F.array_join(F.transform("choices", lambda x: F.concat_ws(":", x["kind"], x["caption"], x["rows"].cast("string"))), "|")
    return choice.select("page_id", "refused", told.alias("choices")).join(lines, "page_id", "left")
