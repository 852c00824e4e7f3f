"""What a page names by itself: read once, without the texts that no source needs."""

from __future__ import annotations

from pagelens.operators import evidence as E
from pagelens.operators import structure as S
from pagelens.operators.nodes import parsed_once
from pagelens.session import stored

PAGES = [
    '<title>T</title><meta name="author" content="Ann"><main><dl><dt>Size</dt><dd>5 <b>cm</b></dd><dt hidden>Gone</dt><dd>6</dd></dl><p itemprop="price">7</p><i property="og:k">8</i><time datetime="2024">now</time></main>',
    '<div class="shop total"><span>Weight</span><span>9</span></div><table><tr><th>Width</th><td>3</td></tr><tr><td>Cut</td><td hidden>4</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table><label for="f">Name</label><input id="f" value="v">',
]


def nodes_of(spark):
    return parsed_once(spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_tiers_that_are_left_out_change_no_other(spark):
    nodes = nodes_of(spark)
    for of in (nodes, stored(S.hidden_nodes(nodes))):
        every, some = stored(E.evidence(of)), stored(E.evidence(of, None, ("declared", "labeled")))
        assert every.where("tier = 'hint'").count() and every.where("tier = 'proximate'").count()
        assert rows(some) == rows(every.where("tier in ('declared', 'labeled')"))


def test_sources_are_read_once(spark):
    fields = spark.createDataFrame([("size", None), ("width", None), ("name", None), ("author", None), ("colour", None)], "name string, hint string")
    out = E.extract_fields(E.field_sources(nodes_of(spark)), fields)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "attrs" not in plan  # no step of the sources themselves
    got = {(r.page_id, r.name): r.value for r in out.where("found").collect()}
    assert got == {(0, "size"): "5 cm", (0, "author"): "Ann", (1, "width"): "3", (1, "name"): "v"}
