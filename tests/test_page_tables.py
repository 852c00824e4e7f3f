"""Tables walked page by page against the same tables from stored nodes."""

from __future__ import annotations

import random

import pytest

from pagelens.operators import page_tables as P
from pagelens.operators import tables as B
from pagelens.operators.nodes import parsed_once
from pagelens.plans.registry import queries
from pagelens.session import stored

ODD = [
    '<table><tr><td rowspan=3>a<td colspan=2>b<td>c</tr><tr></tr><tr><td>d<td rowspan=0>e</tr></table>',
    "<table><thead><tr><td>A</td><td>B</td></tr><tr><td>x</td><td>B</td></tr></thead><tr><th>side</th><td>1<span hidden>no</span></td></tr><tr><th>all</th><th>heads</th></tr></table>",
    f"<table><tr><td><table><tr><th>h</th></tr><tr><td>{'w' * 300}</td></tr></table></td></tr></table>",
    "<table><tfoot><tr><td>foot</td></tr></tfoot><tr><td>one</td></tr><thead><tr><th> head&nbsp; </th></tr></thead></table>",
    '<b id="t">Named <i>so</i></b><div role="Grid" aria-label=" "><div role="row"><span role="gridcell">x</span></div></div><div role="grid" aria-labelledby="t u"><div role="row"><span role="columnheader" aria-colspan=" 2 ">x</span></div><div><p role="cell">y</div></div>',
    "<table><tr><th>a</th></tr><tr></tr><tr><th>b</th></tr></table><table role=' Presentation '><tr><td>l</table><table summary='s'><tr><td><p>one</table><table><tr><td><p>two</table>",
    "<table><caption></caption><caption>second</caption></table><p>none</p>",
    "",
]


def odd_page(seed):
    """Tags of tables in any order, opened and closed at random."""
    r, out = random.Random(seed), []
    for _ in range(60):
        tag = r.choice("table table tr tr tr td td td th thead tfoot caption div p ul".split())
        attrs = r.choice(["", "", "", ' role="row"', ' role="cell"', ' role="table"', ' role="treegrid"', ' role="none"', ' colspan="3"', ' rowspan="2"', ' colspan="x"', ' rowspan="99999999999"', ' id="k"', ' aria-labelledby="k"', ' aria-label="L"'])
        out.append(r.choice([f"<{tag}{attrs}>", f"<{tag}{attrs}>", f"</{tag}>", f"w{r.randint(0, 9)} ", "<br> x "]))
    return "".join(out)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_walked_tables_are_those_of_nodes(spark):
    html = [*ODD, *(odd_page(k) for k in range(150))]
    pages = stored(spark.createDataFrame(list(enumerate(html)), "page_id long, html string"))
    nodes = parsed_once(pages)
    inventory = stored(B.table_inventory(nodes))
    assert inventory.count() > 50
    plain = ["page_id", "table_id", "table_ix", "kind", "rows", "cols"]
    assert rows(P.page_inventory(pages).select(plain)) == rows(inventory.select(plain))
    once = [k for k, h in enumerate(html) if h.count("<caption") < 2 and h.count('id="k"') < 2]  # of several names the nodes give any
    captions = lambda df: rows(df.where(df.page_id.isin(once)).select("page_id", "table_id", "caption"))
    assert captions(P.page_inventory(pages)) == captions(inventory)
    mine, theirs = stored(P.page_cells(pages)), stored(B.table_cells(nodes, inventory))
    assert theirs.count() > 200
    assert rows(mine.drop("first_data_row", "width")) == rows(theirs.select(mine.drop("first_data_row", "width").columns))
    assert rows(B.table_headers(mine)) == rows(B.table_headers(theirs))
    assert rows(B.get_table(mine, 0, 3)) == rows(B.get_table(theirs, 0, 3))


@pytest.mark.parametrize("name", ["c1_table_inventory", "c2_table_cells", "c3_table_headers", "c4_get_table"])
def test_queries_over_tables_join_and_broadcast_nothing(spark, name):
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Broadcast" not in plan
