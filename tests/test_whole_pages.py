"""Pages with more headings, controls and names than fit a screen: none is left out."""

from __future__ import annotations

from pagelens.operators import structure as S
from pagelens.operators.nodes import parsed_once
from pagelens.plans.registry import queries


def stored_pages(spark, tmp_path, *html):
    """A folder with a table of ``pages``, as registered queries read it."""
    rows = [(k, f"https://a.example.com/{k}", h) for k, h in enumerate(html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def test_every_heading_of_a_page(spark, tmp_path):
    d = stored_pages(spark, tmp_path, "".join(f"<h{k % 3 + 1}>head {k}</h{k % 3 + 1}><p>{'x' * (k + 1)}</p>" for k in range(200)))
    assert sorted(r.text for r in queries()["b10_headings"](spark, d).collect()) == sorted(f"head {k}" for k in range(200))
    found = S.headings(parsed_once(spark.read.parquet(f"{d}/pages.parquet"))).orderBy("node_id").collect()
    # level 1 ends at the next of level 1, level 2 at the next of level 1 or 2, level 3 at any
    until = [next((j for j in range(k + 1, 200) if j % 3 <= k % 3), 200) for k in range(200)]
    assert [(r.own_chars, r.section_chars, r.pos, r.n_headings) for r in found] == [(k + 1, sum(range(k + 1, until[k] + 1)), k + 1, 200) for k in range(200)]


def test_every_control_of_a_page(spark, tmp_path):
    links = "".join(f'<li><a href="/{k}">link {k}</a></li>' for k in range(320))
    d = stored_pages(spark, tmp_path, f"<ul>{links}</ul>")
    assert {(r.name, r.ordinal) for r in queries()["b11_controls"](spark, d).collect()} == {(f"link {k}", k + 1) for k in range(320)}


def test_every_element_found_on_a_page(spark, tmp_path):
    d = stored_pages(spark, tmp_path, "".join(f'<a href="/{k}">{"nicht" if k >= 300 else "other"} {k}</a>' for k in range(330)))
    got = [tuple(r) for r in queries()["d1_find_elements"](spark, d).where("query = 'nicht'").select("name", "total").collect()]
    assert sorted(got) == [(f"nicht {k}", 30) for k in range(300, 330)]


def test_every_near_miss_of_a_page(spark, tmp_path):
    d = stored_pages(spark, tmp_path, "".join(f'<a href="/{k}">{"on er" if k == 319 else "er" if k >= 300 else "x"} {k}</a>' for k in range(320)))
    got = sorted((r["rank"], r["name"], r["score"]) for r in queries()["d2_nearest_misses"](spark, d).collect())
    assert got == [(1, "on er 319", 2), *((k - 298, f"er {k}", 1) for k in range(300, 319))]
