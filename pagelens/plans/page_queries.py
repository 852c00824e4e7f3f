"""Registered queries over ``pages`` and ``documents``, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import urls as U
from pagelens.operators import links as L
from pagelens.operators import structure as S
from pagelens.operators.nodes import html_nodes, parsed_once
from pagelens.plans.registry import query
from pagelens.sources.pages import read_table

#: What the driver's markup reduces to in SQL: text between block tags of the body, in order.
BLOCKS_SQL = r"""
raw as (select page_id, url, html, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '^.*<body>', '', 's'), '<!--.*?-->', '', 'gs'), '<(/?)(nav|ul|li|div|article|h1|p|footer|br)( [^>]*)?>', chr(1) || '\1\2' || chr(2), 'g'), '<[^>]*>', '', 'g'), chr(1)) as parts from pages),
cells as (select page_id, url, i, regexp_extract(parts[i], '^([^\x02]*)\x02', 1) as opener, case when i = 1 then parts[i] else regexp_extract(parts[i], '\x02(.*)$', 1, 's') end as body from raw, unnest(range(1, len(parts) + 1)) r(i)),
blocks as (select page_id, url, i, opener, trim(regexp_replace(replace(replace(replace(replace(replace(body, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&lt;', '<'), '&amp;', '&'), '\s+', ' ', 'g')) as text from cells)
"""
LINKS_SQL = r"""
anchors as (select page_id, url, i, m[i] as a from (select page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') as m from pages), unnest(range(1, len(m) + 1)) r(i)),
links as (select page_id, url, i, regexp_extract(a, 'href="([^"]*)"', 1) as href, left(trim(replace(regexp_extract(a, '>([^<]*)<', 1), '&amp;', '&')), 100) as name from anchors)
"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages")


@query("a1_pages", "select page_id, url, length(html) as n_chars from pages")
def a1_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@query(
    "b1_node_counts",
    r"""select page_id, tag, count(*) as n from (select page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script>.*?</script>', '<script>', 'gs'), '<([a-z][a-z0-9]*)', 1)) as tag from pages) group by all""",
)
def b1_node_counts(spark: SparkSession, d: str) -> DataFrame:
    return html_nodes(pages(spark, d)).where("tag not like '#%'").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(
    "c7_links",
    f"with {LINKS_SQL} select page_id, 'nav' as kind, name, href, count(*) as n, count(*) over (partition by page_id) as kind_total from links group by page_id, name, href",
)
def c7_links(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return L.get_links(parsed_once(p), p, limit=None).select("page_id", "kind", "name", "href", "n", "kind_total")


@query(
    "c8_metadata",
    r"""select page_id, nullif(trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g')), '') as title, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang from pages""",
)
def c8_metadata(spark: SparkSession, d: str) -> DataFrame:
    return L.get_metadata(parsed_once(pages(spark, d))).select("page_id", F.nullif("title", F.lit("")).alias("title"), "lang")


@query("b5_text_blocks", f"with {BLOCKS_SQL} select page_id, row_number() over (partition by page_id order by i) as pos, text from blocks where text <> ''")
def b5_text_blocks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    blocks = S.text_blocks(parsed_once(pages(spark, d)))
    return blocks.select("page_id", F.row_number().over(W.partitionBy("page_id").orderBy("start")).cast("long").alias("pos"), "text")


@query(
    "b10_headings",
    f"with {BLOCKS_SQL} select page_id, 1 as level, text, 'document' as landmark from blocks where opener = 'h1' and text <> ''",
)
def b10_headings(spark: SparkSession, d: str) -> DataFrame:
    return S.headings(parsed_once(pages(spark, d))).where("text <> ''").select("page_id", "level", "text", "landmark")


@query(
    "b9_regions",
    f"with {LINKS_SQL}, n as (select page_id, count(*) as c from links group by 1) select p.page_id, x.kind, case when x.kind = 'navigation' then coalesce(n.c, 0) else 0 end as interactive from pages p cross join (values ('navigation'), ('contentinfo')) x(kind) left join n using (page_id)",
)
def b9_regions(spark: SparkSession, d: str) -> DataFrame:
    return S.regions(parsed_once(pages(spark, d))).select("page_id", "kind", "interactive")


@query("b11_controls", f"with {LINKS_SQL} select page_id, 'link' as role, name, 'nav' as cls, row_number() over (partition by page_id order by i) as ordinal from links")
def b11_controls(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return S.nav_flood(S.controls(parsed_once(p), p)).select("page_id", "role", "name", "cls", F.col("ordinal").cast("long").alias("ordinal"))


@query(
    "b16_page_shape",
    f"""with {BLOCKS_SQL}, par as (select page_id, count(*) as paragraphs, sum(length(text)) as prose_chars, max(length(text)) as longest from blocks where text <> '' and opener in ('p', 'br') group by 1)
    select p.page_id, coalesce(paragraphs, 0) as paragraphs, coalesce(prose_chars, 0)::bigint as prose_chars, coalesce(longest, 0) as longest from pages p left join par using (page_id)""",
)
def b16_page_shape(spark: SparkSession, d: str) -> DataFrame:
    return S.page_shape(parsed_once(pages(spark, d))).select("page_id", "paragraphs", "prose_chars", F.col("longest").cast("long").alias("longest"))


@query("d1_find_elements", f"with {LINKS_SQL} select page_id, q as query, name, count(*) over (partition by page_id, q) as total from links, (values ('th'), ('nicht')) v(q) where contains(lower(name), q)")
def d1_find_elements(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    asked = spark.createDataFrame([("th", None), ("nicht", None)], "query string, role string")
    return L.find_elements(S.controls(parsed_once(p), p), asked).select("page_id", "query", "name", "total")


@query(
    "d2_nearest_misses",
    f"with {LINKS_SQL}, s as (select distinct page_id, name, (contains(lower(name), 'on')::int + contains(lower(name), 'er')::int) as score from links) select page_id, name, score, row_number() over (partition by page_id order by score desc, name) as rank from s where score > 0",
)
def d2_nearest_misses(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return L.nearest_misses(S.controls(parsed_once(p), p), "on er").select("page_id", "name", F.col("score").cast("int").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("d3_count_selector", f"with {LINKS_SQL} select page_id, count(l.i) as n from pages p left join links l using (page_id) group by 1")
def d3_count_selector(spark: SparkSession, d: str) -> DataFrame:
    return L.count_selector(parsed_once(pages(spark, d)), "nav ul a[href]")


@query(
    "u1_url_parts",
    r"""select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin, regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1) as host,
    array_to_string(list_slice(string_split(regexp_extract(url, '^https?://([^/?#]+)', 1), '.'), -2, -1), '.') as registrable,
    regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/x/y?z=1' as resolved from pages""",
)
def u1_url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, d).select("page_id", U.url_origin(u).alias("origin"), U.storable_host(u).alias("host"), U.registrable_domain(U.storable_host(u)).alias("registrable"), U.resolve_href(u, F.lit("/x/./w/../y?z=1")).alias("resolved"))


@query(
    "g4_strip_params",
    r"""select page_id, case when contains(url, 'utm_source') then regexp_replace(url, '\?utm_source=[^#]*', '') else url end as url from pages""",
)
def g4_strip_params(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", U.strip_params(F.col("url")).alias("url"))


@query(
    "g21_origin_verdict",
    r"""select page_id, case when regexp_matches(url, '^https?://([^/?#]*\.)?spam-farm\.example\.org(/|$|\?|#)') then 'denied' when not regexp_matches(url, '^https?://[^/?#]*(\.|//)example\.(com|org)(/|$|\?|#)') then 'off-list' else 'allowed' end as verdict from pages""",
)
def g21_origin_verdict(spark: SparkSession, d: str) -> DataFrame:
    from pagelens.operators.logs import origin_verdict

    return origin_verdict(pages(spark, d).select("page_id", "url"), ["*.spam-farm.example.org"], ["*.example.com", "*.example.org"]).select("page_id", "verdict")


@query(
    "u3_text_scalars",
    r"""select doc_id, case when length(s) > 80 then left(s, 80) || '...' else s end as clipped, ceil(length(text) / 3.7::double)::bigint as tokens, left(sha1(text), 12) as fingerprint from (select doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) as s from documents)""",
)
def u3_text_scalars(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read_table(spark, d, "documents").select("doc_id", T.clip(t, 80).alias("clipped"), T.token_cost(t).alias("tokens"), T.fingerprint(t).alias("fingerprint"))


@query(
    "u6_content_words",
    r"""select item_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '' and x not in ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'in', 'is', 'it', 'its', 'my', 'of', 'on', 'or', 'our', 'that', 'the', 'their', 'these', 'this', 'those', 'to', 'was', 'were', 'with', 'your'))))::int as n_words from benchmark""",
)
def u6_content_words(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select("item_id", F.size(T.content_words(F.col("text"))).alias("n_words"))


@query("u4_wrap_roundtrip", "select conv_id, turn, text from conversations")
def u4_wrap_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    wrapped = read_table(spark, d, "conversations").withColumn("w", T.wrap_untrusted(F.col("text"), F.lit("https://a.example.com"), F.substring(F.sha2(F.col("text"), 256), 1, 16)))
    return wrapped.select("conv_id", "turn", T.unwrap_untrusted(F.col("w")).alias("text"))
