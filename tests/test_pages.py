"""Tables, threads, series, monitors, forms and the ledger on small pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions.normal import folded, normal_form
from pagelens.operators import article as A
from pagelens.operators import classify as C
from pagelens.operators import evidence as E
from pagelens.operators import links as L
from pagelens.operators import logs as G
from pagelens.operators import monitor as M
from pagelens.operators import structure as S
from pagelens.operators import tables as B
from pagelens.operators import view as V
from pagelens.operators.nodes import html_nodes, parsed_once
from pagelens.session import few, stored


def nodes_of(spark, *pages):
    return stored(html_nodes(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")))


def grid(cells):
    return {(r.row_ix, r.col_ix): r.text for r in cells.collect()}


def test_spans_that_meet_and_rows_without_cells(spark):
    n = nodes_of(spark, '<table><tr><td rowspan=3>a<td colspan=2>b<td>c</tr><tr></tr><tr><td>d<td rowspan=0>e</tr></table>')
    cells = stored(B.table_cells(n, B.table_inventory(n)))
    assert grid(cells) == {(0, 0): "a", (0, 1): "b", (0, 2): "b", (0, 3): "c", (1, 0): "a", (2, 0): "a", (2, 1): "d", (2, 2): "e"}
    rows = {r.row: (r.cells, r.total_rows) for r in B.get_table(cells).collect()}
    assert rows == {0: (["a", "b", "b", "c"], 3), 1: (["a", "", "", ""], 3), 2: (["a", "d", "e", ""], 3)}
    page = B.get_table(cells, start_row=1, max_rows=1).first()
    assert (page.row, page.next_start_row) == (1, 2)


def test_headers_of_several_rows_and_hidden_text(spark):
    html = "<table><thead><tr><td>A</td><td>B</td></tr><tr><td>x</td><td>B</td></tr></thead><tr><th>side</th><td>1<span hidden>no</span></td></tr><tr><th>all</th><th>heads</th></tr></table>"
    n = stored(S.hidden_nodes(nodes_of(spark, html)))
    cells = stored(B.table_cells(n, B.table_inventory(n)))
    assert grid(cells)[2, 1] == "1"
    assert {r.col_ix: (r.header, r.first_data_row) for r in B.table_headers(cells).collect()} == {0: ("A / x", 2), 1: ("B", 2)}


def test_long_cells_are_clipped_and_nested_tables_are_layout(spark):
    n = nodes_of(spark, f"<table><tr><td><table><tr><th>h</th></tr><tr><td>{'w' * 300}</td></tr></table></td></tr></table>", "<p>no table</p>")
    inventory = stored(B.table_inventory(n))
    assert [(r.page_id, r.rows, r.cols, r.kind) for r in inventory.collect()] == [(0, 2, 1, "table")]
    (long,) = B.table_cells(n, inventory).where("clipped").collect()
    assert long.text == "w" * 200 + "..."
    choice = B.table_choice(inventory, 3).first()
    assert (choice.refused, [c.rows for c in choice.choices]) == ("index-out-of-range", [2])


def post(author, day, text):
    return f'<li class="post"><h4><a href="/u">{author}</a></h4><time datetime="{day}">on {day}</time><div>{text}</div></li>'


def test_threads_and_verdicts(spark):
    long = "words of a post that goes on for a while and on. " * 3
    thread = f'<body><nav><time datetime="1">x</time></nav><ul>{"".join(post(f"user{k}", f"2024-0{k + 1}-01", long) for k in range(4))}</ul></body>'
    short = f"<body><ul>{''.join(post('u', f'2024-0{k + 1}-01', 'hm') for k in range(3))}</ul></body>"
    deep = "<body><div>" + "".join("<section>" + "<div>" * 9 + f'<time datetime="{k}">t</time>{long}' + "</div>" * 9 + "</section>" for k in range(3)) + "</div></body>"
    n = nodes_of(spark, thread, short, deep, "<body><p>no times</p></body>")
    found = stored(A.threads(n))
    rows = found.orderBy("page_id", "post").collect()
    assert [(r.page_id, r.post, r.author, r.at, r.at_text, r.n_posts) for r in rows] == [(0, k + 1, f"user{k}", f"2024-0{k + 1}-01", f"on 2024-0{k + 1}-01", 4) for k in range(4)]
    verdicts = {r.page_id: r.verdict for r in A.article_verdict(n, A.article_body(n), found).collect()}
    assert verdicts[0] == "thread" and verdicts[1] == "none"


def test_series_stops(spark):
    w = "https://a.example.com/"
    rows = [("1", "2", "x" * 10, None, None, None), ("2", "3", "y" * 900, None, None, None), ("3", "1", "z", None, None, None), ("w", "wall", "t", None, None, None), ("wall", None, "t", "captcha", None, None), ("p", None, "t", None, "pdf", None), ("f", "failed", "t", None, None, None), ("failed", None, "t", None, None, True), ("m", "missing", None, None, None, None)]
    chain = spark.createDataFrame([(w + u, w + n if n else None, *rest) for u, n, *rest in rows], "url string, next_url string, text string, wall string, resource string, failed boolean")
    start = spark.createDataFrame([(w + u,) for u in ("1", "w", "p", "f", "m", "none", "wall")], "url string")
    got = {r.series.removeprefix(w): (r.step, r.stop, r.read, r.chars, r.resume) for r in L.read_series(start, chain, max_chars=500).where("stop is not null").collect()}
    assert got == {"1": (3, "loop", True, 511, None), "w": (2, "wall", False, 1, None), "p": (1, "unreadable-resource", False, 0, None), "f": (2, "navigation-failed", False, 1, w + "failed"), "m": (2, "end-of-corpus", False, 0, None), "none": (1, "end-of-corpus", False, 0, None), "wall": (1, "end", True, 1, None)}
    capped = L.read_series(start.where(F.col("url") == w + "1"), chain, max_pages=2).where("stop is not null").first()
    assert (capped.stop, capped.resume) == ("page-cap", w + "3")
    budget = L.read_series(start.where(F.col("url") == w + "1"), chain, budget_chars=5).where("stop is not null").first()
    assert (budget.step, budget.stop, budget.resume) == (1, "char-budget", w + "2")


def test_normal_forms(spark):
    df = spark.createDataFrame([("Ａéﬁ",), (None,), ("plain",), ("ガ한",)], "t string")
    got = df.select(normal_form(F.col("t"), "NFC").alias("c"), normal_form(F.col("t"), "NFKD").alias("d"), folded(F.col("t")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("Ａéﬁ", "Aéfi", "aefi"), (None, None, None), ("plain", "plain", "plain"), ("ガ한", "ガ한", "ガ한")]


def test_monitors_see_what_looks_the_same_and_elements(spark):
    pages = spark.createDataFrame([("u", 1, "Café  now"), ("u", 2, "Café now"), ("u", 3, None)], "url string, observed_at int, text string")
    n = html_nodes(spark.createDataFrame([(1, '<p id="price">5 <b class="big cur">EUR</b></p><p>x</p>'), (2, "<p>gone</p>")], "page_id long, html string")).withColumn("url", F.lit("u")).withColumn("observed_at", F.col("page_id").cast("int"))
    monitors = spark.createDataFrame([(1, "u", "hash", None, None), (2, "u", "appears", "EUR", "#price"), (3, "u", "count", None, "p"), (4, "u", "hash", None, ".cur")], "monitor_id int, url string, condition string, needle string, selector string")
    got = {(r.monitor_id, r.observed_at): (r.value, r.ok) for r in M.observe(pages, monitors, n).collect()}
    assert got[1, 1][0] == got[1, 2][0] and got[1, 3] == (None, False)
    assert got[2, 1] == ("true", True) and got[2, 2] == (None, False)
    assert got[3, 1] == ("2", True) and got[3, 2] == ("1", True)
    assert got[4, 1][1] and not got[4, 2][1]


def test_forms_that_move_money_or_only_search(spark):
    schema = "submitter string, action string, checkbox_labels string, method string, field_count int, payment boolean, secret boolean, textarea boolean, recipient boolean"
    rows = [("Find", "/checkout/search", None, "GET", 1, False, False, False, False), ("Find", "/checkout/search", None, "POST", 1, False, False, False, False), ("Order €20", "/x", None, "POST", 3, None, None, None, None), ("Enviar", None, None, None, None, None, None, True, None), ("Prepaid", "https://delete.example.com/a?b=/delete", None, "POST", 2, False, False, False, False)]
    census = spark.createDataFrame(rows, schema)
    got = [(r.cls, r.reason, r.term, r.search_shaped) for r in C.search_shaped(C.classify_submission(census)).collect()]
    assert got == [("none", None, None, True), ("payment", "words", "checkout", False), ("payment", "amount", "order", False), ("broadcast", "send", "enviar", False), ("none", None, None, False)]


def test_every_unit_has_one_status(spark):
    rows = [(1, k, n, c, n, r, o, h, e, f) for k, n, c, r, o, h, e, f in [("region", 1, None, True, True, False, True, None), ("region", 2, None, True, False, True, False, None), ("region", 3, None, True, False, False, False, None), ("region", 4, None, True, True, False, False, None), ("region", 5, None, True, True, False, True, None), ("affordance", 6, "nav", True, True, False, None, None), ("affordance", 7, "nav", True, True, False, None, None), ("form", 8, None, True, True, None, None, None), ("form", 9, None, True, True, None, None, None), ("field", 10, None, True, True, None, None, 8), ("field", 11, None, True, True, None, None, 8), ("field", 12, None, True, True, None, None, 9), ("heading", 13, None, None, True, None, None, None)]]
    units = spark.createDataFrame(rows, "page_id long, kind string, node_id int, cls string, pos int, reached boolean, owns boolean, has_children boolean, expanded boolean, form_id int")
    ledger = stored(V.unit_ledger(units, {"region": 2, "form": 1}, {"nav": 1}, field_cap=1))
    assert {r.node_id: r.status for r in ledger.collect()} == {1: "printed", 2: "listed_container_only", 3: "no_content", 4: "listed_not_expanded", 5: "dropped_by_rung", 6: "printed", 7: "suppressed_by_quota", 8: "printed", 9: "dropped_by_rung", 10: "printed", 11: "summarized", 12: "dropped_by_rung", 13: "not_reached"}
    assert set(V.STATUSES) == {r.status for r in ledger.collect()}
    sums = {r.level: r.n for r in V.completeness(ledger).groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert sums == dict.fromkeys(("page", "kind", "status", "class"), len(rows))


def test_parameters_in_every_place(spark):
    steps = spark.createDataFrame([("s", 1, {"a": r"x\E.x", "b": "https://x.example.com/x?x=x", "c": None})], "session string, number int, args map<string,string>")
    given = spark.createDataFrame([("p", "x", "yy"), ("q", r"\E.", "-"), ("none", "", "z")], "param string, declared string, given string")
    bound = stored(G.bind_parameters(steps, given.select("param", "declared")))
    assert sorted(r.at for r in bound.where("arg = 'a' and param = 'p'").collect()) == [1, 5]
    got = {(r.arg, r.param): (r.value, r.refused) for r in G.apply_parameters(bound, given.select("param", "given")).collect()}
    assert got == {("a", "p"): (r"yy\E.yy", False), ("a", "q"): ("x-x", False), ("b", "p"): ("https://x.example.com/x?x=x", True)}


def test_large_tables_of_rules_are_not_broadcast(spark):
    assert "ResolvedHint" in few(spark.range(10))._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in few(spark.range(20_000))._jdf.queryExecution().analyzed().toString()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def small_page(spark):
    return spark.createDataFrame([(1, "https://a.example.com/", '<main><dl><dt>Size</dt><dd>5</dd></dl><a id="k" href="/p">to <b>it</b></a></main>')], "page_id long, url string, html string")


def test_nodes_of_few_pages_are_neither_cached_nor_broadcast(spark, tmp_path):
    small_page(spark).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    for nodes in (html_nodes(pages), parsed_once(pages)):
        plan = plan_of(S.frames(nodes, pages)) + plan_of(nodes.join(nodes.where("tag = 'dt'").select("page_id", "parent_id").distinct(), ["page_id", "parent_id"]))
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "InMemoryTableScan" not in plan
    (link,) = S.controls(nodes, pages).collect()
    assert (link.name, link.path, link.cls) == ("to it", "/p", "other")


def test_ancestors_get_ids_and_not_texts(spark):
    nodes = parsed_once(small_page(spark))
    named = S.inner_text(nodes, nodes.where("tag in ('a', 'main')"))
    made = [line for line in plan_of(named).splitlines() if "Generate explode" in line]
    assert made and not any("own_text" in line for line in made)
    assert {r.tag: r.inner for r in named.collect()} == {"a": "to it", "main": "Size5to it"}


def test_matched_keys_are_sent_to_the_pages(spark):
    fields = spark.createDataFrame([("size", None)], "name string, description string")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16")  # as if the pages were many
    try:
        out = E.extract_page(E.evidence(parsed_once(small_page(spark))), fields)
        assert "BroadcastHashJoin [key" in plan_of(out)
        assert [(r.outcome, r.value) for r in out.collect()] == [("found", "5")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
