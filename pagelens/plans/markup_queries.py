"""Queries over markup that both engines build from given tables: a profile page per customer, a table page per order.

The given pages hold no forms, tables, frames or structured data, so these
operators run over pages whose every part follows from a row. The expression
that builds the markup is the same SQL in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import urls as U
from pagelens.operators import article as A
from pagelens.operators import evidence as E
from pagelens.operators import identity as I
from pagelens.operators import lanes as N
from pagelens.operators import links as L
from pagelens.operators import logs as G
from pagelens.operators import page_tables as P
from pagelens.operators import structure as S
from pagelens.operators import tables as B
from pagelens.operators import view as V
from pagelens.operators.nodes import html_nodes, parsed_once
from pagelens.plans.registry import query
from pagelens.sources.pages import read_table

KEY, BALANCE = "cast(c_custkey as varchar(20))", "cast(cast(floor(c_acctbal) as bigint) as varchar(20))"
PROFILE = f"""
'<html lang="en"><head><title>' || c_name || '</title><meta name="author" content="' || c_mktsegment || '"><meta property="og:title" content="About ' || c_name || '">' ||
'<meta name="citation_title" content="Paper ' || {KEY} || '"><meta name="citation_author" content="Ann"><meta name="citation_author" content="Bob ' || {KEY} || '">' ||
case when c_custkey % 7 = 0 then '<meta name="rating" content="adult">' else '' end ||
'<script type="application/ld+json">{{"@type": "Person", "name": "' || c_name || '", "offers": {{"price": ' || {BALANCE} || ', "unit": ["a", "b"]}}}}</script></head><body>' ||
'<nav><a href="/n/' || cast(c_nationkey as varchar(20)) || '">Nation ' || cast(c_nationkey as varchar(20)) || '</a></nav><main><h1>' || c_name || '</h1>' ||
'<p hidden>hidden words of ' || c_mktsegment || '</p><p style="opacity:0">ghost text of more than twenty characters</p>' ||
'<dl><dt>Segment</dt><dd>' || c_mktsegment || '</dd><dt>Nation</dt><dd>' || cast(c_nationkey as varchar(20)) || '</dd></dl>' ||
'<table><tr><td>Balance</td><td>' || {BALANCE} || '</td></tr><tr><td>Name</td><td>' || c_name || '</td></tr></table>' ||
'<ul><li>first ' || c_mktsegment || '</li><li><a href="/c/' || {KEY} || '">second</a></li></ul>' ||
'<form action="/go" method="post"><label for="f1">Search term</label><input id="f1" name="q" value="' || c_mktsegment || '" required><input type="password" name="pw" placeholder="Secret" value="x">' ||
'<select name="s" aria-label="Size"><option>S</option><option>M</option></select><input type="hidden" name="t" value="u"><button>Send ' || c_mktsegment || '</button></form>' ||
'<iframe src="https://other.example.org/f" title="Offer" sandbox="allow-scripts allow-forms"></iframe><iframe srcdoc="x"></iframe></main>' ||
'<footer><a rel="next" href="/p/' || {KEY} || '">next page</a></footer></body></html>'
"""
ORDER_ROW = "'<tr><td>' || cast(l_linenumber as varchar(20)) || '</td><td>' || l_returnflag || '</td><td>' || cast(cast(l_quantity as bigint) as varchar(20)) || '</td></tr>'"
LINES_SQL = "lines as (select l_orderkey, l_linenumber, l_returnflag, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as n from lineitem)"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` in as many partitions as there are cores at least: a table that is small on disk would leave costly work on its rows to a few."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """``page_id, url, html`` of every customer."""
    return spread(read_table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("page_id"), F.expr(f"'https://shop.example.com/c/' || {KEY}").alias("url"), F.expr(PROFILE).alias("html"))


def profile_nodes(spark: SparkSession, d: str) -> DataFrame:
    return parsed_once(profiles(spark, d))


def passing_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The same for queries that read them once; nothing is kept."""
    return html_nodes(profiles(spark, d))


def orders(spark: SparkSession, d: str) -> DataFrame:
    """``page_id, html`` of every order with lines: a caption, a header row and a row per line."""
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = spread(read_table(spark, d, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), F.expr(ORDER_ROW).alias("row")))), lambda x: x["row"]), "").alias("rows"))
    html = F.concat(F.lit("<html><body><table role='presentation'><tr><td>layout</td></tr></table><table><caption>Order "), F.col("l_orderkey").cast("string"), F.lit("</caption><tr><th>Line</th><th colspan='2'>State</th></tr>"), F.col("rows"), F.lit("</table></body></html>"))
    return rows.select(F.col("l_orderkey").alias("page_id"), html.alias("html"))


def order_cells(spark: SparkSession, d: str) -> DataFrame:
    return P.page_cells(orders(spark, d))


@query("b2_hidden_reasons", "select c_custkey as page_id, r as reason from customer, (values ('hidden'), ('opacity-0')) v(r)")
def b2_hidden_reasons(spark: SparkSession, d: str) -> DataFrame:
    return S.hidden_nodes(profile_nodes(spark, d)).where("hidden_reason is not null and tag not like '#%'").select("page_id", F.col("hidden_reason").alias("reason"))


@query(
    "b4_hidden_ledger",
    "select c_custkey as page_id, 'hidden' as reason, 1::bigint as blocks, 2::bigint as nodes, length('hidden words of ' || c_mktsegment) as chars, 1::bigint as injection_suspects, 0::bigint as controls from customer union all select c_custkey, 'opacity-0', 1, 2, length('ghost text of more than twenty characters'), 1, 0 from customer",
)
def b4_hidden_ledger(spark: SparkSession, d: str) -> DataFrame:
    return S.hidden_ledger(S.hidden_nodes(profile_nodes(spark, d))).select("page_id", "reason", "blocks", "nodes", "chars", "injection_suspects", "controls")


CONTROLS_SQL = """
controls as (select c_custkey as page_id, unnest([
 {'tag': 'a', 'role': 'link', 'name': 'Nation ' || c_nationkey, 'source': 'computed'}, {'tag': 'a', 'role': 'link', 'name': 'second', 'source': 'computed'},
 {'tag': 'input', 'role': 'textbox', 'name': 'Search term', 'source': 'computed'}, {'tag': 'input', 'role': 'textbox', 'name': 'Secret', 'source': 'fallback:placeholder'},
 {'tag': 'select', 'role': 'combobox', 'name': 'Size', 'source': 'computed'}, {'tag': 'button', 'role': 'button', 'name': 'Send ' || c_mktsegment, 'source': 'computed'},
 {'tag': 'a', 'role': 'link', 'name': 'next page', 'source': 'computed'}]) as c from customer)
"""


@query("b6_roles", f"with {CONTROLS_SQL} select page_id, c.tag as tag, c.role as role, count(*) as n from controls group by all")
def b6_roles(spark: SparkSession, d: str) -> DataFrame:
    return passing_nodes(spark, d).where(S.is_control()).groupBy("page_id", "tag", S.role_of().alias("role")).agg(F.count("*").alias("n"))


@query("b7_accessible_names", f"with {CONTROLS_SQL} select page_id, c.tag as tag, c.name as name, c.source as name_source from controls")
def b7_accessible_names(spark: SparkSession, d: str) -> DataFrame:
    nodes = profile_nodes(spark, d)
    return S.accessible_names(nodes, nodes.where(S.is_control())).select("page_id", "tag", "name", "name_source")


@query(
    "b8_landmarks",
    "select c_custkey as page_id, m as landmark, n::bigint as n from customer, (values ('navigation', 1), ('form', 4), ('main', 1), ('contentinfo', 1)) v(m, n)",
)
def b8_landmarks(spark: SparkSession, d: str) -> DataFrame:
    return passing_nodes(spark, d).where(S.is_control()).groupBy("page_id", S.landmark_of().alias("landmark")).agg(F.count("*").alias("n"))


@query(
    "b13_forms",
    """select c_custkey as page_id, 'Search term' as label, 'text' as type, true as required, false as secret, c_mktsegment as value, 0::bigint as n_options from customer
    union all select c_custkey, 'Secret', 'password', false, true, null, 0 from customer union all select c_custkey, 'Size', 'select', false, false, null, 2 from customer""",
)
def b13_forms(spark: SparkSession, d: str) -> DataFrame:
    return S.forms(profile_nodes(spark, d)).select("page_id", "label", "type", "required", "secret", "value", "n_options")


@query(
    "b14_form_census",
    "select c_custkey as page_id, 'POST' as method, '/go' as action, 3::bigint as field_count, true as secret, false as payment, false as has_file, false as textarea, 'Send ' || c_mktsegment as submitter from customer",
)
def b14_form_census(spark: SparkSession, d: str) -> DataFrame:
    return S.form_census(profile_nodes(spark, d)).select("page_id", "method", "action", "field_count", "secret", "payment", "has_file", "textarea", "submitter")


@query(
    "b15_frames",
    "select c_custkey as page_id, 'https://other.example.org/f' as src, 'Offer' as title, 'main' as landmark, 'cross-origin' as origin, 'allow-scripts,allow-forms' as sandbox from customer union all select c_custkey, '', '', 'main', 'inherits', '' from customer",
)
def b15_frames(spark: SparkSession, d: str) -> DataFrame:
    return S.frames(passing_nodes(spark, d), profiles(spark, d)).select("page_id", "src", "title", "landmark", "origin", F.array_join("sandbox", ",").alias("sandbox"))


@query("b18_age_declared", "select c_custkey as page_id, 'adult' as evidence from customer where c_custkey % 7 = 0")
def b18_age_declared(spark: SparkSession, d: str) -> DataFrame:
    return S.age_declared(passing_nodes(spark, d))


@query("c1_table_inventory", "select l_orderkey as page_id, 'Order ' || l_orderkey as caption, count(*) + 1 as n_rows, 3::bigint as n_cols from lineitem group by l_orderkey")
def c1_table_inventory(spark: SparkSession, d: str) -> DataFrame:
    found = P.page_inventory(orders(spark, d))
    return found.select("page_id", "caption", F.col("rows").alias("n_rows"), F.col("cols").alias("n_cols"))


@query(
    "c2_table_cells",
    f"with {LINES_SQL} select l_orderkey as page_id, n as row_ix, c.col::bigint as col_ix, c.t as text from (select l_orderkey, n, unnest([{{'col': 0, 't': l_linenumber::varchar}}, {{'col': 1, 't': l_returnflag}}, {{'col': 2, 't': (l_quantity::bigint)::varchar}}]) as c from lines) union all select distinct l_orderkey, 0, c.col, c.t from (select l_orderkey, unnest([{{'col': 0, 't': 'Line'}}, {{'col': 1, 't': 'State'}}, {{'col': 2, 't': 'State'}}]) as c from lineitem)",
)
def c2_table_cells(spark: SparkSession, d: str) -> DataFrame:
    return order_cells(spark, d).select("page_id", F.col("row_ix").cast("long").alias("row_ix"), F.col("col_ix").cast("long").alias("col_ix"), "text")


@query("c3_table_headers", "select distinct l_orderkey as page_id, c::bigint as col_ix, h as header, 1::bigint as first_data_row from lineitem, (values (0, 'Line'), (1, 'State'), (2, 'State')) v(c, h)")
def c3_table_headers(spark: SparkSession, d: str) -> DataFrame:
    return B.table_headers(order_cells(spark, d)).select("page_id", F.col("col_ix").cast("long").alias("col_ix"), "header", F.col("first_data_row").cast("long").alias("first_data_row"))


@query(
    "c4_get_table",
    f"with {LINES_SQL}, t as (select l_orderkey, count(*) as total from lineitem group by 1) select l_orderkey as page_id, n - 1 as row, l_linenumber || '|' || l_returnflag || '|' || l_quantity::bigint as cells, total as total_rows, case when total > 3 then 3 end::bigint as next_start_row from lines join t using (l_orderkey) where n <= 3",
)
def c4_get_table(spark: SparkSession, d: str) -> DataFrame:
    return B.get_table(order_cells(spark, d), 0, 3).select("page_id", F.col("row").cast("long").alias("row"), F.array_join("cells", "|").alias("cells"), "total_rows", F.col("next_start_row").cast("long").alias("next_start_row"))


@query(
    "c6_lists",
    """select c_custkey as page_id, r.pos::bigint as pos, 2::bigint as total, r.term as term, r.text as text, r.href as href from (select c_custkey, unnest([
    {'pos': 0, 'term': 'Segment', 'text': c_mktsegment, 'href': null}, {'pos': 1, 'term': 'Nation', 'text': c_nationkey::varchar, 'href': null},
    {'pos': 0, 'term': null, 'text': 'first ' || c_mktsegment, 'href': null}, {'pos': 1, 'term': null, 'text': 'second', 'href': '/c/' || c_custkey}]) as r from customer)""",
)
def c6_lists(spark: SparkSession, d: str) -> DataFrame:
    found = B.list_items(profile_nodes(spark, d), profiles(spark, d))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "total", "term", "text", "href")


def leaves(nodes: DataFrame) -> DataFrame:
    scripts = nodes.where((F.col("tag") == "script") & (S.attr("type") == "application/ld+json")).select("page_id", F.col("node_id").alias("parent_id"))
    return L.json_ld_leaves(nodes.where("tag = '#raw'").join(scripts, ["page_id", "parent_id"]).select("page_id", F.col("own_text").alias("json")))


@query("c9_json_ld_leaves", "select c_custkey as page_id, r.p as path, r.v as value from (select c_custkey, unnest([{'p': 'name', 'v': c_name}, {'p': 'offers.price', 'v': (floor(c_acctbal)::bigint)::varchar}, {'p': 'offers.unit', 'v': 'a, b'}]) as r from customer)")
def c9_json_ld_leaves(spark: SparkSession, d: str) -> DataFrame:
    return leaves(profile_nodes(spark, d)).select("page_id", "path", "value")


@query(
    "c10_evidence",
    """select c_custkey as page_id, r.t as tier, r.k as key, r.v as value, r.b as "by" from (select c_custkey, unnest([
    {'t': 'declared', 'k': 'author', 'v': c_mktsegment, 'b': 'meta'}, {'t': 'declared', 'k': 'og:title', 'v': 'About ' || c_name, 'b': 'meta'},
    {'t': 'declared', 'k': 'citation_title', 'v': 'Paper ' || c_custkey, 'b': 'meta'}, {'t': 'declared', 'k': 'citation_author', 'v': 'Ann', 'b': 'meta'}, {'t': 'declared', 'k': 'citation_author', 'v': 'Bob ' || c_custkey, 'b': 'meta'},
    {'t': 'declared', 'k': 'title', 'v': c_name, 'b': 'title'}, {'t': 'declared', 'k': 'name', 'v': c_name, 'b': 'json-ld'}, {'t': 'declared', 'k': 'price', 'v': (floor(c_acctbal)::bigint)::varchar, 'b': 'json-ld'}, {'t': 'declared', 'k': 'unit', 'v': 'a, b', 'b': 'json-ld'},
    {'t': 'labeled', 'k': 'Segment', 'v': c_mktsegment, 'b': 'dl'}, {'t': 'labeled', 'k': 'Nation', 'v': c_nationkey::varchar, 'b': 'dl'}, {'t': 'labeled', 'k': 'Balance', 'v': (floor(c_acctbal)::bigint)::varchar, 'b': 'row'}, {'t': 'labeled', 'k': 'Name', 'v': c_name, 'b': 'row'}]) as r from customer)
    union all select c_custkey, 'declared', 'rating', 'adult', 'meta' from customer where c_custkey % 7 = 0""",
)
def c10_evidence(spark: SparkSession, d: str) -> DataFrame:
    nodes = profile_nodes(spark, d)
    return E.evidence(nodes, leaves(nodes)).where("tier in ('declared', 'labeled')").select("page_id", "tier", "key", "value", "by")


WANTED = [("segment", None), ("balance", "the balance"), ("author", None), ("citation author", None), ("colour", None)]


@query(
    "c12_extract_page",
    """select c_custkey as page_id, r.n as name, r.o as outcome, r.v as value, r.t as tier from (select c_custkey, unnest([
    {'n': 'segment', 'o': 'found', 'v': c_mktsegment, 't': 'labeled'}, {'n': 'balance', 'o': 'found', 'v': (floor(c_acctbal)::bigint)::varchar, 't': 'labeled'}, {'n': 'author', 'o': 'found', 'v': c_mktsegment, 't': 'declared'},
    {'n': 'citation author', 'o': 'ambiguous', 'v': null, 't': 'declared'}, {'n': 'colour', 'o': 'not_found', 'v': null, 't': null}]) as r from customer)""",
)
def c12_extract_page(spark: SparkSession, d: str) -> DataFrame:
    fields = spark.createDataFrame(WANTED, "name string, description string")
    return E.extract_page(E.evidence(profile_nodes(spark, d)), fields).select("page_id", "name", "outcome", "value", "tier")


@query("c15_rollup", "select n as name, f * c as found, nf * c as not_found, a * c as ambiguous from (select count(*) as c from customer), (values ('segment', 1, 0, 0), ('balance', 1, 0, 0), ('author', 1, 0, 0), ('citation author', 0, 0, 1), ('colour', 0, 1, 0), (null, 3, 1, 1)) v(n, f, nf, a)")
def c15_rollup(spark: SparkSession, d: str) -> DataFrame:
    fields = spark.createDataFrame(WANTED, "name string, description string")
    return E.rollup_fields(E.extract_page(E.evidence(profile_nodes(spark, d)), fields)).select("name", "found", "not_found", "ambiguous")


@query(
    "c14_extract_fields",
    """select c_custkey as page_id, r.n as name, r.f as found, r.v as value, r.b as "by", r.k as matched_key, r.q as quality from (select c_custkey, unnest([
    {'n': 'segment', 'f': true, 'v': c_mktsegment, 'b': 'dl', 'k': 'Segment', 'q': 'exact'}, {'n': 'price', 'f': true, 'v': (floor(c_acctbal)::bigint)::varchar, 'b': 'json-ld', 'k': 'offers.price', 'q': 'partial'},
    {'n': 'term', 'f': true, 'v': c_mktsegment, 'b': 'form-field', 'k': 'Search term', 'q': 'partial'}, {'n': 'worth', 'f': true, 'v': (floor(c_acctbal)::bigint)::varchar, 'b': 'row', 'k': 'Balance', 'q': 'exact'},
    {'n': 'secret', 'f': false, 'v': null, 'b': null, 'k': null, 'q': null}]) as r from customer)""",
)
def c14_extract_fields(spark: SparkSession, d: str) -> DataFrame:
    nodes = profile_nodes(spark, d)
    fields = spark.createDataFrame([("segment", None), ("price", None), ("term", None), ("worth", "balance"), ("secret", None)], "name string, hint string")
    return E.extract_fields(E.field_sources(nodes, leaves(nodes)), fields).select("page_id", "name", "found", "value", "by", "matched_key", "quality")


@query("c19_article_sources", "select c_custkey as page_id, c_name as title, 'body-h1' as title_source, c_mktsegment as byline from customer")
def c19_article_sources(spark: SparkSession, d: str) -> DataFrame:
    return A.article_meta(profile_nodes(spark, d)).select("page_id", "title", "title_source", "byline")


@query("c23_next_link", "select c_custkey as page_id, 'https://shop.example.com/p/' || c_custkey as next_url, 2 as source from customer")
def c23_next_link(spark: SparkSession, d: str) -> DataFrame:
    return L.next_link(profile_nodes(spark, d), profiles(spark, d)).select("page_id", "next_url", "source")


@query("c25_citation_meta", "select c_custkey as page_id, 'title' as field, 'Paper ' || c_custkey as value from customer union all select c_custkey, 'author', 'Ann; Bob ' || c_custkey from customer")
def c25_citation_meta(spark: SparkSession, d: str) -> DataFrame:
    return L.citation_meta(profile_nodes(spark, d)).select("page_id", "field", "value")


@query(
    "c26_resource_kind",
    "select event_id, case event_type when 'view' then 'pdf' when 'click' then 'binary' when 'error' then 'binary' else 'html' end as kind from events",
)
def c26_resource_kind(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr("case event_type when 'view' then 'application/PDF; q=1' when 'click' then 'application/zip' when 'purchase' then 'text/html; charset=utf-8' else '' end")
    url = F.expr("case event_type when 'error' then 'blob:https://a.example.com/1' else 'https://a.example.com/x' end")
    return L.resource_kind(read_table(spark, d, "events").select("event_id", url.alias("url"), kind.alias("content_type"), F.lit(0).alias("readable_chars"))).select("event_id", "kind")


@query(
    "c27_filename_for",
    "select p_partkey, case p_size % 3 when 0 then p_type || '.pdf' when 1 then p_type || ' x.txt' else p_type || '.html' end as filename from part",
)
def c27_filename_for(spark: SparkSession, d: str) -> DataFrame:
    said = F.expr("case p_size % 3 when 0 then 'attachment; filename=\"' || p_type || '.pdf\"' when 1 then 'attachment; filename*=UTF-8''''' || p_type || '%20x.txt' end")
    return read_table(spark, d, "part").select("p_partkey", L.filename_for(F.expr("'https://a.example.com/d/' || p_type || '.html?q=1'"), said).alias("filename"))


def refs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Customers as refs minted on the page of their nation, and their units now, each nation a page of its own."""
    c = read_table(spark, d, "customer")
    page, ref = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.col("c_custkey").cast("string")
    mod = F.col("c_custkey") % 10
    asked = c.select(page.alias("handle"), ref.alias("ref"))
    registry = c.where(mod != 0).select(
        ref.alias("ref"), F.when(mod == 1, F.lit("elsewhere")).otherwise(page).alias("minted_on"), F.when(mod == 2, "https://a.example.com/old").otherwise("https://a.example.com/").alias("url"), (mod == 3).alias("turn_local"), F.lit(False).alias("gone"),
        F.lit("link").alias("role"), F.col("c_name").alias("name"), F.lit("main").alias("landmark"), F.lit(None).cast("string").alias("landmark_label"), F.concat(F.lit("k"), ref).alias("key"),
    )
    now = c.where(mod != 9).select(
        page.alias("handle"), F.concat(F.lit("u"), ref).alias("ref"), F.lit("link").alias("role"), F.when(mod == 4, F.concat("c_name", F.lit(" new"))).otherwise(F.col("c_name")).alias("name"),
        F.when(mod == 6, F.lit("navigation")).otherwise("main").alias("landmark"), F.lit(None).cast("string").alias("landmark_label"), F.when(mod.isin(5, 6, 7), F.lit("other")).otherwise(F.concat(F.lit("k"), ref)).alias("key"),
    )
    twin = now.where(F.endswith("name", F.lit("7"))).withColumn("ref", F.concat("ref", F.lit("b")))
    state = c.select(page.alias("handle")).distinct().withColumn("url", F.lit("https://a.example.com/")).withColumn("modal", F.col("handle") == "n3")
    return asked, registry, now.unionByName(twin), state


@query(
    "f5_resolve_refs",
    """select 'n' || c_nationkey as handle, c_custkey::varchar as ref, case when c_nationkey = 3 then 'MODAL' else case c_custkey % 10 when 0 then 'NOT_FOUND' when 1 then 'BAD_PARAMS' when 2 then 'STALE' when 3 then 'AMBIGUOUS' when 4 then 'REBOUND' when 5 then 'REBOUND' when 6 then 'REBOUND' when 7 then 'AMBIGUOUS' when 8 then 'OK' else 'STALE' end end as outcome,
    case when c_nationkey = 3 then 'modal' else case c_custkey % 10 when 0 then 'never minted' when 1 then 'another page' when 2 then 'url-changed' when 3 then 'turn-local ref' when 4 then 'key, name changed' when 5 then 'role and name in landmark' when 6 then 'role and name anywhere' when 7 then 'role and name in landmark' when 8 then 'key' else 'no match' end end as tier,
    case when c_nationkey <> 3 and c_custkey % 10 in (4, 5, 6, 8) then 'u' || c_custkey end as now from customer""",
)
def f5_resolve_refs(spark: SparkSession, d: str) -> DataFrame:
    return I.resolve_refs(*refs(spark, d))


@query(
    "e5_view",
    """with u as (select user_id % 50 as page_id, case event_type when 'error' then 'field' when 'click' then 'nav' when 'view' then 'form_control' when 'signup' then 'heading' else 'region' end as unit, event_id as pos from events),
    r as (select *, row_number() over (partition by page_id, unit order by pos) as n, count(*) over (partition by page_id, unit) as total from u where unit in ('field', 'form_control', 'region')),
    c as (select *, case unit when 'field' then 48 when 'form_control' then 12 else 6 end as cap from r)
    select page_id, unit, pos, total, greatest(total - cap, 0) as suppressed from c where n <= cap""",
)
def e5_view(spark: SparkSession, d: str) -> DataFrame:
    unit = F.expr("case event_type when 'error' then 'field' when 'click' then 'nav' when 'view' then 'form_control' when 'signup' then 'heading' else 'region' end")
    units = read_table(spark, d, "events").select((F.col("user_id") % 50).alias("page_id"), unit.alias("unit"), F.col("event_id").alias("pos"))
    return V.view(units, "forms", rung=16).select("page_id", "unit", "pos", "total", "suppressed")


@query("g2_is_analytics", "select event_id, event_type in ('click', 'view') as analytics from events")
def g2_is_analytics(spark: SparkSession, d: str) -> DataFrame:
    url = F.expr("case event_type when 'click' then 'https://Stats.Criteo.net/p' when 'view' then 'https://www.google-analytics.com/collect' else 'https://a.example.com/x' end")
    return read_table(spark, d, "events").select("event_id", U.is_analytics(url).alias("analytics"))


@query("g4_tracking_preset", "select event_id, 'https://a.example.com/x?id=' || event_id || '#t' as url from events")
def g4_tracking_preset(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://a.example.com/x?UTM_Source=a&gclid=1&id="), F.col("event_id").cast("string"), F.lit("&icid=2&s_kwcid=3#t"))
    return read_table(spark, d, "events").select("event_id", U.strip_params(url).alias("url"))


@query("i2_registrable_domain", "select c_custkey, case c_custkey % 4 when 0 then 'shop' || c_nationkey || '.co.uk' when 1 then 'shop' || c_nationkey || '.go.id' when 2 then 'shop' || c_nationkey || '.com' end as domain from customer")
def i2_registrable_domain(spark: SparkSession, d: str) -> DataFrame:
    host = F.expr("case c_custkey % 4 when 0 then 'www.a.shop' || c_nationkey || '.co.uk' when 1 then 'b.shop' || c_nationkey || '.go.id' when 2 then 'c.shop' || c_nationkey || '.com' else 'govt.nz' end")
    return read_table(spark, d, "customer").select("c_custkey", U.registrable_domain(host).alias("domain"))


@query("u7_visual_tokens", "select p_partkey, (ceil((p_size * 40) / 28.0) * ceil((p_size * 30 + 1) / 28.0))::bigint as tokens from part")
def u7_visual_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", T.visual_tokens(F.col("p_size") * 40, F.col("p_size") * 30 + 1).cast("long").alias("tokens"))


@query(
    "u9_human_span",
    "select event_id, case when s < 90 then s || ' s' when s < 5400 then (2 * s + 60) // 120 || ' min' when s < 129600 then (2 * s + 3600) // 7200 || ' h' else (2 * s + 86400) // 172800 || ' days' end as span from (select event_id, (event_id * 37) % 1000000 as s from events)",
)
def u9_human_span(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", T.human_span((F.col("event_id") * 37) % 1000000).alias("span"))


@query(
    "f1_anchor_keys",
    """select c_custkey, case when c_custkey % 3 = 0 then 'testid' else 'role-name-landmark' end as strongest, case when c_custkey % 3 = 0 then 'p|main||t' || c_custkey else 'p|main||link|' || c_name end as key,
    (1 + (c_custkey % 3 = 0)::int)::int as n from customer""",
)
def f1_anchor_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = anchored(spark, d).select("c_custkey", I.anchor_keys().alias("k"))
    return keys.select("c_custkey", F.get("k", F.lit(0))["kind"].alias("strongest"), F.get("k", F.lit(0))["key"].alias("key"), F.size("k").alias("n"))


def anchored(spark: SparkSession, d: str) -> DataFrame:
    """Customers as links, every third with a test id; of every fourth the name is that of its segment."""
    none = F.lit(None).cast("string")
    testid = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("t"), F.col("c_custkey").cast("string")))
    fields = {"page_key": F.lit("p"), "role": F.lit("link"), "name": F.col("c_name"), "landmark": F.lit("main"), "landmark_label": F.lit(""), "labelled_ancestor": none, "attr_id": none, "attr_testid": testid, "attr_name": none}
    return read_table(spark, d, "customer").withColumn("anchor", F.struct(*(v.alias(k) for k, v in fields.items())))


@query(
    "f2_unique_keys",
    """with u as (select c_nationkey as handle, c_custkey as ref, c_mktsegment as name from customer), n as (select *, count(*) over (partition by handle, name) as n from u) select handle, ref, 'role-name-landmark' as key_kind from n where n = 1""",
)
def f2_unique_keys(spark: SparkSession, d: str) -> DataFrame:
    named = anchored(spark, d).withColumn("anchor", F.col("anchor").withField("name", F.col("c_mktsegment")).withField("attr_testid", F.lit(None).cast("string")))
    units = named.select(F.col("c_nationkey").alias("handle"), F.lit(1).alias("token"), F.col("c_custkey").alias("ref"), F.lit("link").alias("kind"), "anchor")
    return I.unique_keys(units).select("handle", "ref", "key_kind")


@query(
    "f6_nearest_by_name",
    """with a as (select c_nationkey as handle, 'customer ' || c_custkey as asked_name from customer where c_custkey % 50 = 0), p as (select a.handle, asked_name, c_name as name, 1 - levenshtein(asked_name, c_name) / greatest(length(asked_name), length(c_name), 1)::double as ratio from a join customer c on a.handle = c.c_nationkey)
    select handle, asked_name, name, ratio from (select *, row_number() over (partition by handle, asked_name order by ratio desc, name desc) as n from p where ratio >= 0.4) where n = 1""",
)
def f6_nearest_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth customer is asked for by a name that is not quite its own, among all of its page."""
    c = read_table(spark, d, "customer")
    asked = c.where("c_custkey % 50 = 0").select(F.col("c_nationkey").alias("handle"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name"))
    return I.nearest_by_name(asked, c.select(F.col("c_nationkey").alias("handle"), F.col("c_name").alias("name"))).select("handle", "asked_name", "name", "ratio")


@query(
    "d4_disambiguate",
    """with f as (select c_nationkey as page_id, c_custkey as node_id, c_mktsegment as name, '/p' || c_custkey % 40 as path, 'm' || c_custkey % 30 as landmark, c_custkey as ordinal from customer),
    w as (select *, count(*) over k as n, count(distinct path) over k as paths, count(distinct landmark) over k as marks from f window k as (partition by page_id, name))
    select page_id, node_id, case when n = 1 or paths = n then '' when marks = n then 'in ' || landmark else '#' || ordinal || ' link' end as hint from w""",
)
def d4_disambiguate(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    found = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("page_id"), key.alias("node_id"), F.lit("link").alias("role"), F.col("c_mktsegment").alias("name"), F.concat(F.lit("/p"), (key % 40).cast("string")).alias("path"), F.concat(F.lit("m"), (key % 30).cast("string")).alias("landmark"), key.alias("ordinal"))
    return L.disambiguate(found).select("page_id", "node_id", "hint")


@query(
    "e2_rank_score",
    "select p_partkey, (case when p_size % 4 > 0 then 8.0 else -6.0 end + case when p_size > 25 then 6.0 else 0.0 end + least(6.0, sqrt(p_size * 100) / 20) - least(6.0, p_retailprice / 2000) + case when p_size % 2 = 0 then 1.0 else 0.0 end)::double as score from part",
)
def e2_rank_score(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_size") % 4 > 0, F.col("p_name"))
    return read_table(spark, d, "part").select("p_partkey", V.rank_score(name, F.col("p_size") > 25, F.col("p_size") * 100, F.col("p_retailprice"), F.col("p_size") % 2 == 0).alias("score"))


@query(
    "e6_next_calls",
    """with r as (select c_nationkey as page_id, c_custkey as region_id, (2 * (c_custkey % 9 - c_custkey % 5) + 3 * (c_custkey % 4) + least(c_custkey % 60, 40)) * case when c_custkey % 6 = 0 then 0.4 else 1 end as value from customer)
    select page_id, region_id, rank from (select *, row_number() over (partition by page_id order by value desc, region_id) as rank from r where value > 0) where rank <= 6""",
)
def e6_next_calls(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    regions = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("page_id"), key.alias("region_id"), (key % 9).alias("interactive"), (key % 5).alias("prose_links"), (key % 4).alias("headings"), (key % 60).alias("text_blocks"), (key % 6 == 0).alias("has_children"))
    return V.next_calls(regions).select("page_id", "region_id", F.col("rank").cast("long").alias("rank"))


@query(
    "g12_auth_expiry",
    """with k as (select c_nationkey as state, case c_custkey % 3 when 0 then 'sessionid' when 1 then 'auth_token' else 'theme' end as name, case when c_custkey % 5 = 0 then -1.0 else 1700000000 + c_custkey * 1000.0 end as expires from customer)
    select state, min(case when expires > 0 then expires end)::double as expires_at, count(*) filter (expires <= 0) as session_cookies,
    case when min(case when expires > 0 then expires end) - 1700050000 <= 0 then 'expired' when min(case when expires > 0 then expires end) - 1700050000 < 86400 then 'under 24 h' when min(case when expires > 0 then expires end) is null then 'none' else 'valid' end as note from k where name <> 'theme' group by state""",
)
def g12_auth_expiry(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    cookies = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("state"), F.when(key % 3 == 0, "sessionid").when(key % 3 == 1, "auth_token").otherwise("theme").alias("name"), F.when(key % 5 == 0, F.lit(-1.0)).otherwise(1700000000 + key * 1000.0).alias("expires"))
    return G.auth_expiry(cookies, 1700050000.0).select("state", "expires_at", "session_cookies", "note")


@query("g15_list_workflows", "select c_custkey from customer where c_nationkey = 3 and c_custkey % 4 < 2")
def g15_list_workflows(spark: SparkSession, d: str) -> DataFrame:
    host = F.expr("case c_custkey % 4 when 0 then 'Shop' when 1 then 'www.shop' when 2 then 'webshop' else 'x.shopping' end || c_nationkey || '.example.com'")
    return G.list_workflows(read_table(spark, d, "customer").withColumn("host", host), "shop3.example.com").select("c_custkey")


@query(
    "i11_coerce_records",
    "select c_custkey, not (c_custkey % 7 = 0 or c_custkey % 11 = 0 or c_custkey % 13 = 0) as good from customer",
)
def i11_coerce_records(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    raw = read_table(spark, d, "customer").select(
        "c_custkey", F.when(key % 13 != 0, F.lit("a.example.com")).alias("host"), F.lit("direct").alias("lane"), F.when(key % 7 == 0, F.lit("-1")).otherwise("2").alias("ok"), F.lit("0").alias("blocked"), F.lit("1").alias("dropped"),
        F.when(key % 11 == 0, F.lit("2024-13-01")).otherwise("2024-01-31").alias("last_ok"), F.lit(None).cast("string").alias("last_bad"),
    )
    good, rejects = N.coerce_records(raw)
    return good.select("c_custkey", F.lit(True).alias("good")).union(rejects.select("c_custkey", F.lit(False)))
