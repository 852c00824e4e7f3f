"""Operators on small literal inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import urls as U
from pagelens.operators import classify as C
from pagelens.operators import identity as I
from pagelens.operators import structure as S
from pagelens.operators import tables as B
from pagelens.operators.nodes import NODES, PageWalk, html_nodes, page_rows
from pagelens.sources import rules


def nodes_of(spark, html: str):
    pages = spark.createDataFrame([(1, "https://a.example.com/x/y?q=1", html)], "page_id long, url string, html string")
    return spark.createDataFrame(html_nodes(pages).collect(), NODES), pages


def test_parser_repairs_markup():
    rows = page_rows(1, "<body><p>one<p><b>two<br>three</p></i><ul><li>a<li>b</ul><script>x='</p>'</script>")
    assert [r["tag"] for r in rows] == ["body", "p", "#text", "p", "b", "#text", "br", "#text", "ul", "li", "#text", "li", "#text", "script", "#raw"]
    assert rows[0]["last_desc"] == len(rows) - 1
    assert page_rows(1, None) == []


def test_plain_markup_is_read_whole_and_as_the_standard_parser_does():
    plain = "<!DOCTYPE html><html><head><title>a &amp; b</title><script>x && y</script></head><body><!-- c --><p hidden class='d e'>1 &lt; 2<br><ul><li id=\"f\">g<li>h</ul></body></html>"
    assert PageWalk(1).plain(plain) == len(plain)
    odd = ["<P>a", "<script>'<p>'</script>b", "<title>a<b>c</title>", "<p id=x a=\"1&amp;2\">", "<iframe>&amp;</iframe>", "a < b", "<!---->c", "<a b=\"1\"c>", "&am", "<p"]
    for html in [plain, *(f"<div>x &amp; y{o}</div><i>z" for o in odd)]:
        walk = PageWalk(1)
        walk.feed(html)
        walk.close()
        walk.close_to(0)
        assert page_rows(1, html) == walk.rows


def test_nearest_by_name_does_not_pair_all_names(spark):
    names = [f"Customer#{k:06d}" for k in range(3000)] + ["", "é", "Customer#0000101"]
    wanted = [f"customer {k}" for k in range(0, 3000, 100)] + ["é", "zzzz", "customer 10"]
    current = spark.createDataFrame([("a", x) for x in names] + [("b", "only"), (None, "x"), ("a", None)], "handle string, name string")
    asked = spark.createDataFrame([("a", x) for x in wanted] + [("b", "onlx"), ("c", "x"), ("a", None)], "handle string, name string")
    pairs = asked.withColumnRenamed("name", "w").join(current.distinct(), "handle").withColumn("r", 1 - F.levenshtein("w", "name") / F.greatest(F.length("w"), F.length("name"), F.lit(1))).where("r >= 0.4")
    brute = {tuple(r) for r in pairs.groupBy("handle", "w").agg(F.max(F.struct("r", "name")).alias("b")).select("handle", "w", "b.name", "b.r").collect()}
    found = I.nearest_by_name(asked, current)
    assert {tuple(r) for r in found.collect()} == brute
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "levenshtein" in line]
    assert joins and all("floor" in line for line in joins)  # pairs are ruled out where they are made


def test_hidden_text_is_apart(spark):
    n, _ = nodes_of(spark, '<body><p style="opacity:0">secret</p><p>seen <span hidden>not</span></p><details><summary>More</summary><p>closed</p></details></body>')
    h = spark.createDataFrame(S.hidden_nodes(n).collect(), S.hidden_nodes(n).schema)
    assert {(r.tag, r.hidden_reason) for r in h.where("hidden_reason is not null and tag <> '#text'").collect()} == {("p", "opacity-0"), ("span", "hidden"), ("p", "details-collapsed")}
    assert S.visible_text(h).first().text == "seen\nMore"


def test_table_spans(spark):
    n, _ = nodes_of(spark, "<table><tr><th>A</th><th colspan=2>B</th></tr><tr><td rowspan=2>1</td><td>2</td><td>3</td></tr><tr><td>4</td><td>5</td></tr></table>")
    cells = B.table_cells(n, B.table_inventory(n))
    got = {(r.row_ix, r.col_ix): r.text for r in cells.collect()}
    assert got == {(0, 0): "A", (0, 1): "B", (0, 2): "B", (1, 0): "1", (1, 1): "2", (1, 2): "3", (2, 0): "1", (2, 1): "4", (2, 2): "5"}


def test_resolve_href(spark):
    cases = {"/p": "https://a.example.com/p", "../z": "https://a.example.com/z", "?k=1": "https://a.example.com/x/y?k=1", "#t": "https://a.example.com/x/y?q=1#t", "//b.example.org/q": "https://b.example.org/q", "w": "https://a.example.com/x/w"}
    df = spark.createDataFrame([("https://a.example.com/x/y?q=1", h) for h in cases], "b string, h string")
    assert {r.h: r.u for r in df.select("h", U.resolve_href(F.col("b"), F.col("h")).alias("u")).collect()} == cases


def test_robots(spark):
    robots = spark.createDataFrame([("https://a.example.com", "User-agent: x\nDisallow: /\nUser-agent: *\nDisallow: /private # no\nDisallow:\n")], "origin string, body string")
    urls = spark.createDataFrame([("https://a.example.com/private/1",), ("https://a.example.com/open",)], "url string")
    assert {r.url: r.rule for r in rules.robots_advisory(robots, urls).collect()} == {"https://a.example.com/private/1": "/private", "https://a.example.com/open": None}


def test_bind_refs(spark):
    anchor = "struct<page_key:string,role:string,name:string,landmark:string,landmark_label:string,labelled_ancestor:string,attr_id:string,attr_testid:string,attr_name:string>"
    row = lambda token, ref, name, testid: ("h", token, ref, "link", ("k", "link", name, "main", "", None, None, testid, None))
    schema = f"handle string, token int, ref long, kind string, anchor {anchor}"
    before = spark.createDataFrame([row(1, 1, "a", "t1"), row(1, 2, "b", None), row(1, 3, "c", None), row(1, 4, "c", None)], schema)
    after = spark.createDataFrame([row(2, 11, "renamed", "t1"), row(2, 12, "b", None), row(2, 13, "c", None)], schema)
    assert {r.new_ref: r.ref for r in I.bind_refs(before, after).collect()} == {11: 1, 12: 2, 13: None}


def test_classify_soft_block(spark):
    df = spark.createDataFrame([("u", "u", 200, {}, "Just a moment...", "", "")], "url string, landed_url string, status int, headers map<string,string>, title string, body string, source string")
    assert [(r.label, r.confidence) for r in C.classify_response(df).collect()] == [("botwall", "confirmed")]


def test_fields_from_evidence(spark):
    from pagelens.operators import evidence as E

    n, _ = nodes_of(spark, '<head><meta property="og:price" content="9"></head><body><dl><dt>Colour</dt><dd>red</dd></dl><table><tr><td>Weight</td><td>5 kg</td></tr></table><div><span>Size:</span><span>XL</span></div><p itemprop="price">10</p></body>')
    fields = spark.createDataFrame([("colour", None), ("weight", "item weight"), ("size", None), ("vendor", None), ("price", None)], "name string, description string")
    found = E.evidence(n)
    got = {r.name: (r.outcome, r.value, r.tier) for r in E.extract_page(spark.createDataFrame(found.collect(), found.schema), fields).collect()}
    assert got == {"colour": ("found", "red", "labeled"), "weight": ("found", "5 kg", "labeled"), "size": ("found", "XL", "proximate"), "vendor": ("not_found", None, None), "price": ("found", "10", "declared")}


def test_parameters_keep_origins(spark):
    from pagelens.operators import logs as G

    steps = spark.createDataFrame([("s", 1, {"url": "https://a.example.com/find?q=cats"})], "session string, number int, args map<string,string>")
    bound = G.bind_parameters(steps, spark.createDataFrame([("q", "cats"), ("host", "a.example.com")], "param string, declared string"))
    got = {r.param: (r.value, r.refused) for r in G.apply_parameters(bound, spark.createDataFrame([("q", "dogs"), ("host", "b.example.org")], "param string, given string")).collect()}
    assert got == {"q": ("https://a.example.com/find?q=dogs", False), "host": ("https://a.example.com/find?q=cats", True)}


def test_inline_links(spark):
    from pagelens.operators import article as A

    long = "A sentence with some words, and more of them, so that it counts as prose. " * 3
    n, pages = nodes_of(spark, f"<body><article><p>{long}<a href='/z'>here</a></p><p>{long}</p></article></body>")
    body = A.article_body(n)
    row = A.inline_links(n, pages, spark.createDataFrame(body.collect(), body.schema)).first()
    assert row.linked and "[here](/z)" in row.text
