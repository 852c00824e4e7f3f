"""Queries over pages of several shapes each: outcomes of fields, names by reference, sources of an article's facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators import article as A
from pagelens.operators import evidence as E
from pagelens.operators import structure as S
from pagelens.operators.nodes import parsed_once
from pagelens.plans.markup_queries import spread
from pagelens.plans.registry import query
from pagelens.session import stored
from pagelens.sources.pages import read_table


def customer_pages(spark: SparkSession, d: str, body: str) -> DataFrame:
    """``page_id, html``: a page per customer around an SQL expression."""
    return spread(read_table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("<html><body>"), F.expr(body), F.lit("</body></html>")).alias("html"))


COLOURS = """case c_custkey % 8 when 0 then '<dl><dt>Colour</dt><dd>' || c_mktsegment || '</dd></dl>' when 1 then '<dl><dt>Colour</dt><dd><span hidden>red</span></dd></dl>' when 2 then '<dl><dt>Colour</dt><dd></dd></dl>'
    when 3 then '<div class="colour"></div>' when 4 then '<meta name="colour" content="red"><p property="v:colour">blue</p>' when 5 then '<p property="colour">' || c_mktsegment || '</p><dl><dt>Colour</dt><dd>grey</dd></dl>'
    when 6 then '<div class="colour inner">tint</div>' else '<p>nothing</p>' end"""


@query(
    "c12_outcomes",
    """select c_custkey as page_id, case k when 0 then 'found' when 1 then 'hidden' when 2 then 'empty' when 4 then 'ambiguous' when 5 then 'found' else 'not_found' end as outcome, case when k in (0, 5) then c_mktsegment end as value,
    case when k in (0, 1, 2) then 'labeled' when k in (4, 5) then 'declared' end as tier, case when k = 4 then 'blue|red' end as candidates, case k when 0 then '' when 5 then 'grey' end as disagreement,
    case when k in (3, 6) then 1 when k = 7 then 0 end::bigint as hints, k = 3 as styling_only from (select *, c_custkey % 8 as k from customer)""",
)
def c12_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A field that is found, hidden, empty, ambiguous, contradicted by a lower tier, or named by a class alone."""
    nodes = stored(S.hidden_nodes(parsed_once(customer_pages(spark, d, COLOURS))))
    every = customer_pages(spark, d, COLOURS).select("page_id")
    out = E.extract_page(E.evidence(nodes), spark.createDataFrame([("colour", None)], "name string, description string"))
    rows = out.select("page_id", "outcome", "value", "tier", F.array_join("candidates", "|").alias("candidates"), F.array_join("disagreement", "|").alias("disagreement"), "hints", "styling_only")
    # a page without any evidence has no row
    bare = every.join(rows, "page_id", "left_anti").select("page_id", F.lit("not_found").alias("outcome"), *(F.lit(None).cast("string").alias(c) for c in ("value", "tier", "candidates", "disagreement")), F.lit(0).cast("long").alias("hints"), F.lit(False).alias("styling_only"))
    return rows.unionByName(bare)


NAMED = """'<span id="a">One ' || c_name || '</span><span id="b">Two</span><button aria-labelledby="b missing a">x</button><form><fieldset><legend>Leg ' || c_mktsegment || '</legend><input name="q" title="T"></fieldset></form>' ||
    '<table><caption>Cap</caption><tr><td>1</td></tr></table><figure><figcaption>Fig</figcaption></figure><div role="group" aria-labelledby="b"><section aria-label=" Near "><p><a href="/x">link</a></p></section></div><nav aria-label="Menu"><div><a href="/y">deep</a></div></nav>'"""


@query(
    "b7_references",
    """select c_custkey as page_id, r.t as tag, r.n as name, r.s as name_source from (select c_custkey, unnest([{'t': 'button', 'n': 'Two One ' || c_name, 's': 'computed'}, {'t': 'fieldset', 'n': 'Leg ' || c_mktsegment, 's': 'computed'}, {'t': 'table', 'n': 'Cap', 's': 'computed'}, {'t': 'figure', 'n': 'Fig', 's': 'computed'}, {'t': 'input', 'n': 'T', 's': 'fallback:title'}]) as r from customer)""",
)
def b7_references(spark: SparkSession, d: str) -> DataFrame:
    """Several references in order, a missing one among them; legends and captions."""
    nodes = parsed_once(customer_pages(spark, d, NAMED))
    return S.accessible_names(nodes, nodes.where("tag in ('button', 'fieldset', 'table', 'figure', 'input')")).select("page_id", "tag", "name", "name_source")


@query("b8_labelled_ancestors", """select c_custkey as page_id, r.h as href, r.l as labelled_ancestor from (select c_custkey, unnest([{'h': '/x', 'l': ''}, {'h': '/y', 'l': ''}]) as r from customer)""")
def b8_labelled_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """A label at or above the landmark is the landmark's own and scopes nothing."""
    nodes = parsed_once(customer_pages(spark, d, NAMED))
    return S.labelled_ancestors(nodes, nodes.where("tag = 'a'")).select("page_id", F.col("attrs")["href"].alias("href"), "labelled_ancestor")


ARTICLES = """case c_custkey % 5 when 0 then '<script type="application/ld+json">{"@type": "NewsArticle", "headline": "Head ' || c_name || '", "author": [{"name": "Ann"}, "Bob"], "datePublished": "2024-01-02", "dateModified": "2024-01-03"}</script><h1>Other</h1>'
    when 1 then '<script type="application/ld+json">{"@graph": [{"@type": "Organization", "name": "Org"}, {"@type": ["Thing", "blogposting"], "name": "Post ' || c_name || '", "author": "Cy"}]}</script><meta name="author" content="Meta">'
    when 2 then '<script type="application/ld+json">{"@type": "Person", "name": "No"}</script><h1>' || c_name || '</h1><span class="post-byline">By Dee</span><time datetime="2024-05-06">then</time>'
    when 3 then '<script type="application/ld+json">{"@type": "Article"</script><meta property="og:title" content="Og"><meta name="date" content="2020"><p itemprop="author">Eve</p><p rel="author">Fay</p>'
    else '<script type="application/ld+json">[{"@type": "Thing"}, {"@type": "Article", "name": "Second"}]</script><meta property="article:modified_time" content="2021"><meta property="article:published_time" content="2019"><time datetime="2018">t</time>' end"""


@query(
    "c19_json_ld_sources",
    """select c_custkey as page_id, case k when 0 then 'Head ' || c_name when 1 then 'Post ' || c_name when 2 then c_name when 3 then 'Og' else 'Second' end as title, case k when 2 then 'body-h1' when 3 then 'og:title' else 'json-ld' end as title_source,
    case k when 0 then 'Ann, Bob' when 1 then 'Cy' when 2 then 'By Dee' when 3 then 'Eve' end as byline, case when k < 2 then 'json-ld' when k < 4 then 'markup' end as byline_source,
    case k when 0 then '2024-01-02' when 2 then '2024-05-06' when 3 then '2020' when 4 then '2019' end as published, case k when 0 then 'json-ld' when 2 then 'time[datetime]' when 3 then 'meta[name=date]' when 4 then 'meta[article:published_time]' end as published_source,
    case k when 0 then '2024-01-03' when 4 then '2021' end as modified, case k when 0 then 'json-ld' when 4 then 'meta[article:modified_time]' end as modified_source from (select *, c_custkey % 5 as k from customer)""",
)
def c19_json_ld_sources(spark: SparkSession, d: str) -> DataFrame:
    """JSON-LD as an object, a graph and a list, of another type, and broken; authors in three forms; markup and metas behind it."""
    return A.article_meta(parsed_once(customer_pages(spark, d, ARTICLES)))
